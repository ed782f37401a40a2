"""Term vectors leave Python in parts, whatever a batch of Arrow rows holds."""

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.analysis import CaseFolder, PolyAnalyzer, Tokenizer
from glyphmill.operators import highlight
from glyphmill.plans.schema import Schema, full_text

WORDS = PolyAnalyzer(analyzers=[CaseFolder(), Tokenizer()])
SCHEMA = Schema().spec_field("text", full_text(WORDS, highlightable=True))


def documents(spark, n=500):
    """One partition; every 50th text empty, every 70th null, the last one longer than a slice of these tests."""
    text = F.when(F.col("id") % 50 == 0, "").when(F.col("id") % 70 == 1, None).when(F.col("id") == n - 1, F.repeat(F.lit("Long one "), 300)).otherwise(F.concat(F.lit("b a B "), F.col("id") % 7, F.lit(" a c'd ä")))
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))


def plain(texts):
    out = {}
    for key, text in texts:
        for p, (term, a, b) in enumerate(WORDS.spans([(text, 0, len(text))]) if text else []):
            for column, value in zip(out.setdefault((key, term), ([], [], [])), (p, a, b), strict=True):
                column.append(value)
    return out


@pytest.mark.parametrize("tokens", [1, 40, 1 << 16])
def test_term_vectors_by_slices(spark, monkeypatch, tokens):
    monkeypatch.setattr(highlight, "VECTOR_TOKENS", tokens)
    docs = documents(spark)
    found = highlight.term_vectors(docs, SCHEMA, "text").collect()
    want = plain(docs.collect())
    assert len(found) == len(want) and {(r.doc_id, r.term): (r.positions, r.starts, r.ends) for r in found} == want


def test_term_vectors_leave_python_in_parts(spark, monkeypatch):
    """More than one batch leaves for a batch of many rows; before, all rows of it were held as Python objects."""
    monkeypatch.setattr(highlight, "VECTOR_TOKENS", 100)
    sent = []
    seen = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: sent.append(f) or seen(self, f, schema))
    docs = documents(spark)
    highlight.term_vectors(docs, SCHEMA, "text")
    texts = [r for r in docs.collect() if r.text is not None]
    batch = pa.RecordBatch.from_pydict({"k": [r.doc_id for r in texts], "t": [r.text for r in texts]})
    parts = list(sent[0]([batch]))
    assert len(parts) > 10 and max(pa.compute.sum(pa.compute.list_value_length(p.column("positions"))).as_py() for p in parts[:-1]) <= 107
