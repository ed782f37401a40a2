"""Queries to columns.

Whatever its shape, a query becomes two expressions over one row per document:
whether it matches, and its score.  The row holds, for each term that the query
names, its frequency (and positions where a phrase needs them), and each field's
norm.  So any Boolean tree costs one grouping of the postings by document, and no
join for each clause; Catalyst prunes what is not used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.similarity import Similarity

from .query import ANDQuery, CustomQuery, FilterQuery, LeafQuery, MatchAllQuery, NoMatchQuery, NOTQuery, ORQuery, PhraseQuery, PolyQuery, PrefixQuery, ProximityQuery, Query, RangeQuery, RequiredOptionalQuery, TermQuery
from .schema import Schema


@dataclass
class Needs:
    """What a query reads: terms by field, which of them with positions, prefixes, stored columns."""

    terms: dict[tuple[str, str], bool] = field(default_factory=dict)
    prefixes: list[tuple[str, str]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    #: Whether a document can match without any of the terms.
    all_documents: bool = False

    def term_list(self) -> list[tuple[str, str]]:
        return sorted(self.terms)

    def fields(self) -> list[str]:
        return sorted({f for f, _ in self.terms})


KNOWN = (TermQuery, PhraseQuery, ProximityQuery, PrefixQuery, RangeQuery, MatchAllQuery, NoMatchQuery, LeafQuery, PolyQuery, NOTQuery, RequiredOptionalQuery, FilterQuery, CustomQuery)


def needs(query: Query) -> Needs:
    out = Needs()

    def walk(q: Query) -> bool:
        """Collects; returns whether the query can match a document without its terms."""
        if isinstance(q, CustomQuery):
            return q.needs(out)
        if isinstance(q, TermQuery):
            out.terms.setdefault((q.field, q.term), False)
            return False
        if isinstance(q, PhraseQuery | ProximityQuery):
            for t in q.terms:
                out.terms[(q.field, t)] = out.terms.get((q.field, t), False) or len(q.terms) > 1
            return False
        if isinstance(q, PrefixQuery):
            if (q.field, q.prefix) not in out.prefixes:
                out.prefixes.append((q.field, q.prefix))
            return False
        if isinstance(q, RangeQuery):
            if q.field not in out.columns:
                out.columns.append(q.field)
            return True
        if isinstance(q, LeafQuery):
            raise ValueError("a leaf of a query string has to be expanded first")
        if not isinstance(q, KNOWN):
            raise TypeError(f"{type(q).__name__} is no query that can be compiled: derive it from CustomQuery")
        open_ = [walk(c) for c in q.children()]
        if isinstance(q, MatchAllQuery | NOTQuery):
            return True
        if isinstance(q, ANDQuery):
            return bool(open_) and all(open_)
        if isinstance(q, RequiredOptionalQuery):
            return open_[0]
        return any(open_)

    out.all_documents = walk(query)
    return out


@dataclass
class Statistics:
    """Corpus figures a query is weighed with: documents, and documents of each term."""

    total: int
    doc_freq: dict[tuple[str, str], int]


def tf_name(i: int) -> str:
    return f"tf_{i}"


def positions_name(i: int) -> str:
    return f"pos_{i}"


def norm_name(field_name: str) -> str:
    return f"norm_{field_name}"


def rich_name(i: int) -> str:
    return f"rich_{i}"


def prefix_name(i: int) -> str:
    return f"prefix_{i}"


def _within(start: Column, reach: int):
    return lambda x: (x >= start) & (x - start < reach)


class Compiler:
    def __init__(self, query: Query, schema: Schema, statistics: Statistics, similarity: Similarity | None = None):
        self.query, self.schema, self.statistics = query, schema, statistics
        self.needs = needs(query)
        self.similarity = similarity or Similarity()
        self._index = {t: i for i, t in enumerate(self.needs.term_list())}
        self._query_norm = self.similarity.query_norm(self._sum_of_squares(query, 1.0))

    def match(self) -> Column:
        return self._match(self.query)

    def score(self) -> Column:
        return self._score(self.query, 1.0)

    # Weights.

    def _sim(self, name: str) -> Similarity:
        return self.schema.type_of(name).sim()

    def _idf(self, q: Query) -> float:
        terms = [q.term] if isinstance(q, TermQuery) else q.terms
        sim = self._sim(q.field)
        return sum(sim.idf(self.statistics.doc_freq.get((q.field, t), 0), self.statistics.total) for t in terms)

    def _sum_of_squares(self, q: Query, boost: float) -> float:
        boost = boost * q.boost
        if isinstance(q, CustomQuery):
            return q.sum_of_squares(self, boost)
        if isinstance(q, TermQuery | PhraseQuery | ProximityQuery):
            return (self._idf(q) * boost) ** 2
        if isinstance(q, NOTQuery):
            return 0.0
        if isinstance(q, PolyQuery | RequiredOptionalQuery):
            return sum(self._sum_of_squares(c, boost) for c in q.children()) * boost * boost
        return 1.0

    # For custom queries.

    def frequency(self, field_name: str, term: str) -> Column:
        """How often a term, which the query's ``needs`` must name, occurs in the document."""
        return self._tf(field_name, term)

    def positions(self, field_name: str, term: str) -> Column:
        """Its positions, null where it does not occur; ``needs`` must ask for them."""
        return F.col(positions_name(self._index[(field_name, term)]))

    def norm(self, field_name: str) -> Column:
        return F.coalesce(F.col(norm_name(field_name)), F.lit(0.0))

    def idf(self, field_name: str, term: str) -> float:
        return self._idf(TermQuery(field_name, term))

    @property
    def query_norm(self) -> float:
        return self._query_norm

    def weight(self, q: Query) -> float:
        """The weight of a term or phrase by itself, its boost included."""
        return self._weight(q, q.boost)

    def _weight(self, q: Query, boost: float) -> float:
        idf = self._idf(q)
        return idf * boost * idf * self._query_norm

    # Whether a query can match at all, from document frequencies.

    def _alive(self, q: Query) -> bool:
        df = self.statistics.doc_freq
        if isinstance(q, TermQuery):
            return df.get((q.field, q.term), 0) > 0
        if isinstance(q, PhraseQuery | ProximityQuery):
            return bool(q.terms) and all(df.get((q.field, t), 0) > 0 for t in q.terms)
        if isinstance(q, ANDQuery):
            return bool(q.clauses) and all(map(self._alive, q.clauses))
        if isinstance(q, ORQuery):
            return any(map(self._alive, q.clauses))
        if isinstance(q, RequiredOptionalQuery):
            return self._alive(q.required)
        if isinstance(q, FilterQuery):
            return self._alive(q.query)
        return True

    # Frequencies.

    def _tf(self, name: str, term: str) -> Column:
        return F.coalesce(F.col(tf_name(self._index[(name, term)])), F.lit(0))

    def _frequency(self, q: Query) -> Column:
        """How often a term or phrase occurs in the document."""
        if isinstance(q, TermQuery):
            return self._tf(q.field, q.term)
        if len(q.terms) == 1:
            return self._tf(q.field, q.terms[0])
        first, *rest = (F.col(positions_name(self._index[(q.field, t)])) for t in q.terms)

        def holds(p: Column) -> Column:
            ok = F.lit(True)
            for i, other in enumerate(rest, 1):
                if isinstance(q, PhraseQuery):
                    ok = ok & F.array_contains(other, p + i)
                else:
                    ok = ok & F.exists(other, _within(p + i, q.within))
            return ok

        return F.coalesce(F.size(F.filter(first, holds)), F.lit(0)) if q.terms else F.lit(0)

    def _match(self, q: Query) -> Column:
        if not self._alive(q) or isinstance(q, NoMatchQuery):
            return F.lit(False)
        if isinstance(q, CustomQuery):
            return F.coalesce(q.match(self), F.lit(False))
        if isinstance(q, TermQuery | PhraseQuery | ProximityQuery):
            if isinstance(q, TermQuery) or len(q.terms) == 1:
                return self._frequency(q) > 0
            found = F.lit(True)
            for t in q.terms:  # cheap: most documents lack a term
                found = found & (self._tf(q.field, t) > 0)
            return found & (self._frequency(q) > 0)
        if isinstance(q, PrefixQuery):
            return F.coalesce(F.col(prefix_name(self.needs.prefixes.index((q.field, q.prefix)))), F.lit(False))
        if isinstance(q, RangeQuery):
            return self._in_range(q)
        if isinstance(q, MatchAllQuery):
            return F.lit(True)
        if isinstance(q, NOTQuery):
            return ~self._match(q.negated)
        if isinstance(q, FilterQuery):
            return self._match(q.query)
        if isinstance(q, RequiredOptionalQuery):
            return self._match(q.required)
        out = None
        for c in q.children():
            m = self._match(c)
            out = m if out is None else (out & m if isinstance(q, ANDQuery) else out | m)
        return out

    def _in_range(self, q: RangeQuery) -> Column:
        kind = self.schema.type_of(q.field)
        if not kind.sortable:
            raise ValueError(f"field {q.field!r} is not sortable")
        c, ok = kind.sort_key(F.col(q.field)), F.lit(True)
        if q.lower is not None:
            bound = kind.sort_key(F.lit(q.lower))
            ok = ok & ((c >= bound) if q.include_lower else (c > bound))
        if q.upper is not None:
            bound = kind.sort_key(F.lit(q.upper))
            ok = ok & ((c <= bound) if q.include_upper else (c < bound))
        return F.coalesce(ok, F.lit(q.nulls_match_open_upper and q.upper is None))

    def _score(self, q: Query, boost: float) -> Column:
        """The score of a document that matches ``q``; other rows may hold anything."""
        boost = boost * q.boost
        if not self._alive(q):
            return F.lit(0.0)
        if isinstance(q, CustomQuery):
            return q.score(self, boost)
        if isinstance(q, TermQuery | PhraseQuery | ProximityQuery):
            kind, weight = self.schema.type_of(q.field), F.lit(self._weight(q, boost))
            if kind.posting == "match":
                return weight
            first = q.term if isinstance(q, TermQuery) else q.terms[0]
            norm = rich_name(self._index[(q.field, first)]) if kind.posting == "rich" else norm_name(q.field)
            return kind.sim().tf(self._frequency(q)) * weight * F.coalesce(F.col(norm), F.lit(0.0))
        if isinstance(q, PrefixQuery):
            return F.lit(1.0)
        if isinstance(q, MatchAllQuery):
            return F.lit(float(boost))
        if isinstance(q, RequiredOptionalQuery):
            extra = F.when(self._match(q.optional), self._score(q.optional, boost)).otherwise(F.lit(0.0))
            return self._score(q.required, boost) + extra
        if isinstance(q, ANDQuery):
            return sum((self._score(c, boost) for c in q.clauses), F.lit(0.0))
        if isinstance(q, ORQuery):
            alive = [c for c in q.clauses if self._alive(c)]
            total, count = F.lit(0.0), F.lit(0)
            for c in alive:
                m = self._match(c)
                total = total + F.when(m, self._score(c, boost)).otherwise(F.lit(0.0))
                count = count + m.cast("int")
            return total if len(alive) < 2 else total * self.similarity.coord(count, len(alive))
        return F.lit(0.0)
