"""Where a query's rows come from: texts analyzed on the fly, or a stored index.

Both give one row per document with the columns that ``plans.compiler`` names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.similarity import Similarity
from glyphmill.plans.compiler import Compiler, Needs, Statistics, norm_name, positions_name, prefix_name, rich_name, tf_name
from glyphmill.plans.schema import Schema

#: Terms whose document frequencies one aggregate counts.
COUNT_TERMS = 400


def _equal_to(term: str):
    return lambda x: x == term


def _starting_with(prefix: str):
    return lambda x: x.startswith(prefix)


def positions_of(terms: Column, term: str) -> Column:
    """0-based positions of a term in an array of terms."""
    return F.filter(F.transform(terms, lambda t, i: F.when(t == term, i)), lambda p: p.isNotNull())


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with their columns computed before anything above uses them.

    The optimizer would copy an analyzed field into each expression that names it,
    inner loops of phrases included; a generator of one row stops that.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def mean_boost(terms: Column, boosts: Column, term: str) -> Column:
    """Mean boost of the positions of a term; null where it does not stand."""
    own = F.filter(F.transform(terms, lambda t, i: F.when(t == term, F.get(boosts, i))), lambda b: b.isNotNull())
    return F.aggregate(own, F.lit(0.0), lambda s, b: s + b.cast("double")) / F.when(F.size(own) > 0, F.size(own))


class TextSource:
    """Documents whose fields are analyzed as they are read.

    The row of a document comes from its own text, so a query runs as one scan
    without a shuffle before the top-k.
    """

    def __init__(self, docs: DataFrame, schema: Schema, key: str = "doc_id", boost: str | None = None):
        self.docs, self.schema, self.key, self.boost = docs, schema, key, boost

    def _terms(self, name: str) -> Column:
        return F.when(F.col(name).isNotNull(), self.schema.type_of(name).terms(F.col(name)))

    def _analyzed(self, fields: list[str], columns: list[str]) -> DataFrame:
        kept = [self.key, *dict.fromkeys(c for c in columns if c != self.key)]
        boost = F.col(self.boost) if self.boost else F.lit(1.0)
        boosts = [self.schema.type_of(f).analyzer.boosts(F.col(f)).alias(f"boosts_{f}") for f in fields if self.schema.type_of(f).posting == "rich"]
        rows = self.docs.select(*kept, *(self._terms(f).alias(f"terms_{f}") for f in fields), *boosts, boost.alias("doc_boost"))
        return computed_once(rows) if fields else rows

    def statistics(self, need: Needs) -> Statistics:
        terms = need.term_list()
        fields = need.fields()
        rows = self._analyzed(fields, [])
        total, found = None, {}
        for i in range(0, max(len(terms), 1), COUNT_TERMS):
            some = terms[i : i + COUNT_TERMS]
            counts = [F.sum(F.coalesce(F.array_contains(f"terms_{f}", t), F.lit(False)).cast("int")).alias(f"c{j}") for j, (f, t) in enumerate(some)]
            row = rows.agg(F.count("*").alias("n"), *counts).first()
            total = row["n"]
            found |= {t: row[f"c{j}"] or 0 for j, t in enumerate(some)}
        return Statistics(total, found)

    def rows(self, need: Needs, columns: list[str]) -> DataFrame:
        prefix_fields = [f for f, _ in need.prefixes]
        fields = list(dict.fromkeys([*need.fields(), *prefix_fields]))
        base = self._analyzed(fields, [*need.columns, *columns])
        out = [F.col(c) for c in dict.fromkeys([self.key, *need.columns, *columns])]
        for i, (f, t) in enumerate(need.term_list()):
            out.append(F.size(F.filter(f"terms_{f}", _equal_to(t))).alias(tf_name(i)))
            if need.terms[(f, t)]:
                out.append(positions_of(F.col(f"terms_{f}"), t).alias(positions_name(i)))
            kind = self.schema.type_of(f)
            if kind.posting == "rich":
                out.append((mean_boost(F.col(f"terms_{f}"), F.col(f"boosts_{f}"), t) * F.lit(kind.boost)).alias(rich_name(i)))
        for f in need.fields():
            kind = self.schema.type_of(f)
            out.append(kind.sim().field_norm(F.size(f"terms_{f}"), F.col("doc_boost") * F.lit(kind.boost)).alias(norm_name(f)))
        for i, (f, p) in enumerate(need.prefixes):
            out.append(F.exists(f"terms_{f}", _starting_with(p)).alias(prefix_name(i)))
        leaves = base.select(*out)
        return computed_once(leaves) if fields else leaves

    def stored(self) -> DataFrame:
        return self.docs


def wanted_rows(need: Needs) -> Column:
    """Whether a query reads a posting row; the file reader prunes by it."""
    wanted = [(F.col("field") == f) & F.col("term").isin([t for g, t in need.term_list() if g == f]) for f in need.fields()]
    wanted += [(F.col("field") == f) & F.col("term").startswith(p) for f, p in need.prefixes]
    return reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False)


def gathered(postings: DataFrame, need: Needs, key: str = "doc_id") -> DataFrame:
    """One row per document from its posting rows (field, term, key, tf, norm, positions)."""
    terms = need.term_list()
    aggs = []
    for i, (f, t) in enumerate(terms):
        here = (F.col("field") == f) & (F.col("term") == t)
        aggs.append(F.max(F.when(here, F.col("tf"))).alias(tf_name(i)))
        if need.terms[(f, t)]:
            aggs.append(F.max(F.when(here, F.col("positions"))).alias(positions_name(i)))
        aggs.append(F.max(F.when(here, F.col("norm"))).alias(rich_name(i)))
    for f in need.fields():
        aggs.append(F.max(F.when(F.col("field") == f, F.col("norm"))).alias(norm_name(f)))
    for i, (f, p) in enumerate(need.prefixes):
        aggs.append(F.max((F.col("field") == f) & F.col("term").startswith(p)).alias(prefix_name(i)))
    return postings.groupBy(key).agg(*(aggs or [F.count("*").alias("n")]))


def matches(source, query, columns: list[str] = (), need_score: bool = True, statistics: Statistics | None = None, similarity: Similarity | None = None) -> DataFrame:
    """(key, score, columns) of the documents that match; score is null where none is needed."""
    from glyphmill.plans.compiler import needs

    need = needs(query)
    compiler = Compiler(query, source.schema, statistics or source.statistics(need), similarity)
    rows = source.rows(need, list(columns)).where(compiler.match())
    score = compiler.score() if need_score else F.lit(None).cast("double")
    return rows.select(source.key, score.cast("double").alias("score"), *(c for c in dict.fromkeys(columns) if c != source.key))
