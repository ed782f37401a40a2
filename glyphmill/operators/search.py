"""Searching: hits of a query with sorting, paging and stored fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.similarity import Similarity
from glyphmill.operators.docset import DocSet
from glyphmill.plans.compiler import Compiler, Statistics, needs
from glyphmill.plans.parser import QueryParser
from glyphmill.plans.query import NoMatchQuery, Query
from glyphmill.plans.schema import Schema
from glyphmill.sources.reader import matches


@dataclass(frozen=True)
class SortRule:
    """By a field's value, by score (best first), or by document id; ``reverse`` turns it round."""

    kind: str = "score"
    field: str | None = None
    reverse: bool = False

    def __post_init__(self):
        if self.kind not in ("field", "score", "doc_id"):
            raise ValueError(f"cannot sort by {self.kind!r}")
        if (self.kind == "field") != (self.field is not None):
            raise ValueError("a field rule, and only it, names a field")


@dataclass(frozen=True)
class SortSpec:
    rules: tuple[SortRule, ...]

    def __init__(self, rules):
        object.__setattr__(self, "rules", tuple(rules))
        if not self.rules:
            raise ValueError("a sort needs a rule")

    def fields(self) -> list[str]:
        return [r.field for r in self.rules if r.kind == "field"]

    def columns(self, key: str, schema=None) -> list:
        """Sort columns, by a field's own comparison; missing values come last, or first when reversed; ids break ties."""
        out = []
        for r in self.rules:
            if r.kind == "score":
                out.append(F.col("score").asc() if r.reverse else F.col("score").desc())
            else:
                c = F.col(r.field if r.kind == "field" else key)
                if r.kind == "field" and schema is not None:
                    c = schema.type_of(r.field).sort_key(c)
                out.append(c.desc_nulls_first() if r.reverse else c.asc_nulls_last())
        return [*out, F.col(key).asc()]

    def needs_score(self) -> bool:
        return any(r.kind == "score" for r in self.rules)


BY_SCORE = SortSpec([SortRule("score"), SortRule("doc_id")])


class _Search:
    """What all searchers share: they differ in ``collect`` and ``_stored``."""

    schema: Schema
    key: str

    def glean(self, query: str | Query | None) -> Query:
        if query is None:
            return NoMatchQuery()
        return query if isinstance(query, Query) else self.parser.parse(query)

    def _checked(self, sort: SortSpec | None) -> SortSpec:
        for name in (sort or BY_SCORE).fields():
            if not self.schema.type_of(name).sortable:
                raise ValueError(f"field {name!r} is not sortable")
        return sort or BY_SCORE

    def collect(self, query: str | Query | None, columns: list[str] = (), need_score: bool = True, within: DocSet | None = None) -> DataFrame:
        raise NotImplementedError

    def _stored(self) -> DataFrame:
        raise NotImplementedError

    def total_hits(self, query: str | Query | None) -> int:
        return self.collect(query, need_score=False).count()

    def docset(self, query: str | Query | None) -> DocSet:
        """The matching documents as a set; ``persist`` it to filter many searches by it."""
        return DocSet(self.collect(query, need_score=False).select(self.key), self.key)

    def top_docs(self, query: str | Query | None, num_wanted: int = 10, offset: int = 0, sort: SortSpec | None = None, round_score: int | None = None, within: DocSet | None = None) -> DataFrame:
        spec = self._checked(sort)
        found = self.collect(query, spec.fields(), spec.needs_score(), within)
        if round_score is not None:
            found = found.withColumn("score", F.round("score", round_score))
        top = found.orderBy(*spec.columns(self.key, self.schema))
        return (top.offset(offset) if offset else top).limit(num_wanted)

    def hits(self, query: str | Query | None, num_wanted: int = 10, offset: int = 0, sort: SortSpec | None = None, within: DocSet | None = None) -> DataFrame:
        """Top documents with their stored fields, best first; fields that are only sortable are left out.

        The page is joined by key; adaptive execution sends it around if it is small.
        """
        spec = self._checked(sort)
        page = self.top_docs(query, num_wanted, offset, sort, within=within).select(self.key, "score")
        found = self._stored().join(page, self.key).orderBy(*spec.columns(self.key, self.schema))
        hidden = [n for n, kind in self.schema.fields.items() if not kind.stored and n != self.key]
        return found.drop(*hidden)


class Searcher(_Search):
    """Searches one source of documents."""

    def __init__(self, source, parser: QueryParser | None = None, similarity: Similarity | None = None):
        self.source, self.schema, self.key = source, source.schema, source.key
        self.parser = parser or QueryParser(self.schema)
        self.similarity = similarity

    def collect(self, query: str | Query | None, columns: list[str] = (), need_score: bool = True, within: DocSet | None = None) -> DataFrame:
        """All matching documents; group, count or join them like any frame."""
        found = matches(self.source, self.glean(query), list(columns), need_score, similarity=self.similarity)
        return within.of(found) if within is not None else found

    def _stored(self) -> DataFrame:
        return self.source.stored()

    def statistics(self, query: Query) -> Statistics:
        return self.source.statistics(needs(query))

    def weigher(self, query: Query) -> Callable[[Query], float]:
        """Weights of the query's terms and phrases for a ``Highlighter``: rare ones are hotter."""
        compiler = Compiler(query, self.schema, self.statistics(query), self.similarity)
        return lambda q: compiler.weight(q)


class PolySearcher(_Search):
    """Several sources with one schema, searched as one: figures are summed, ids shifted."""

    def __init__(self, searchers: list[Searcher], offsets: list[int] | None = None):
        first = searchers[0].schema
        if any(s.schema != first for s in searchers):
            raise ValueError("all sources must have the same schema")
        self.searchers, self.schema = searchers, first
        self.key = searchers[0].key
        self.parser = searchers[0].parser
        self.offsets = offsets or self._starts()

    def _starts(self) -> list[int]:
        out, at = [], 0
        for s in self.searchers:
            out.append(at)
            at += (-1 if (last := s.source.stored().agg(F.max(s.key)).first()[0]) is None else last) + 1
        return out

    def statistics(self, query: Query) -> Statistics:
        parts = [s.statistics(query) for s in self.searchers]
        return Statistics(sum(p.total for p in parts), {t: sum(p.doc_freq.get(t, 0) for p in parts) for t in parts[0].doc_freq})

    def _shifted(self, frames: list[DataFrame]) -> DataFrame:
        moved = [f.withColumn(self.key, F.col(self.key) + F.lit(o)) for f, o in zip(frames, self.offsets, strict=True)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moved)

    def collect(self, query: str | Query | None, columns: list[str] = (), need_score: bool = True, within: DocSet | None = None) -> DataFrame:
        q = self.glean(query)
        shared = self.statistics(q)
        found = self._shifted([matches(s.source, q, list(columns), need_score, shared, s.similarity) for s in self.searchers])
        return within.of(found) if within is not None else found

    def _stored(self) -> DataFrame:
        return self._shifted([s._stored() for s in self.searchers])
