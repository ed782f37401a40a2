"""Python's share of a build is cut to slices, whatever a batch of Arrow rows holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_term_vectors import SCHEMA, WORDS, documents, plain

from glyphmill.functions.analysis import Tokenizer
from glyphmill.plans.schema import Schema, full_text, string
from glyphmill.sources import index


class Rising(Tokenizer):
    """The boost of a token is its place."""

    def boosts(self, text):
        return F.transform(self.terms(text), lambda t, i: i.cast("double"))


@pytest.mark.parametrize("tokens", [1, 40, 1 << 18])
def test_inversion_by_slices(spark, monkeypatch, tokens):
    monkeypatch.setattr(index, "SLICE_TOKENS", tokens)
    docs = documents(spark)
    want = {k: v[0] for k, v in plain(docs.collect()).items()}
    found = index.invert(docs, SCHEMA, "doc_id").collect()
    assert len(found) == len(want) and {(r.doc_id, r.term): r.positions for r in found} == want
    assert all(r.tf == len(r.positions) and r.norm > 0 for r in found)


def test_slices_hold_few_tokens():
    offsets = np.array([5, 5, 8, 9, 30, 31, 31, 33])
    assert list(index.token_slices(offsets, 4)) == [(0, 3), (3, 4), (4, 7)]
    assert list(index.token_slices(np.array([0]), 4)) == []


def test_rich_boosts_by_slices(spark, monkeypatch):
    monkeypatch.setattr(index, "SLICE_TOKENS", 3)
    docs = spark.createDataFrame([(1, "x y x"), (2, ""), (3, "y y x x")], "doc_id long, text string")
    found = index.invert(docs, Schema().spec_field("text", full_text(Rising(), posting="rich")), "doc_id").collect()
    assert {(r.doc_id, r.term): r.norm for r in found} == {(1, "x"): 1.0, (1, "y"): 1.0, (3, "y"): 0.5, (3, "x"): 2.5}


def test_slices_leave_by_term(spark, monkeypatch):
    """Each slice is one run by term and document, in the order in which Spark compares strings."""
    texts = ["b \U00010400 a b", None, "é \uffff a", "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    schema = Schema().spec_field("text", full_text(Tokenizer(r"\S+")))
    found = [(r.term, r.doc_id, r.positions) for r in index.invert(docs, schema, "doc_id").collect()]
    assert found == [("a", 0, [2]), ("a", 2, [2]), ("a", 4, [0]), ("b", 0, [0, 3]), ("b", 4, [1]), ("é", 2, [0]), ("\uffff", 2, [1]), ("\U00010400", 0, [1])]
    monkeypatch.setattr(index, "SLICE_TOKENS", 4)
    assert [(r.term, r.doc_id) for r in index.invert(docs, schema, "doc_id").collect()][:4] == [("a", 0), ("b", 0), ("\U00010400", 0), ("a", 2)]


def test_slices_of_many_terms(spark):
    """More terms in a slice than 16 bits can number."""
    words = [f"w{i}" for i in range(70_000)]
    docs = spark.createDataFrame([(1, " ".join(words[::-1])), (2, " ".join(words))], "doc_id long, text string").coalesce(1)
    found = index.invert(docs, Schema().spec_field("text", full_text(Tokenizer())), "doc_id").select("term", "doc_id", F.col("positions")[0].alias("p"), "tf").collect()
    assert [tuple(r) for r in found] == [x for i, w in sorted(enumerate(words), key=lambda iw: iw[1]) for x in ((w, 1, 69_999 - i, 1), (w, 2, i, 1))]


def test_fields_of_odd_names(spark, tmp_path):
    """Each field is written by itself, under a name that Spark's partition paths escape."""
    schema = Schema().spec_field("te xt:%=1", full_text(WORDS)).spec_field("kind", string())
    docs = spark.createDataFrame([(1, "a b", "k"), (2, "b", None)], ["doc_id", "te xt:%=1", "kind"])
    with index.Indexer(spark, str(tmp_path / "i"), schema) as w:
        w.add(docs).commit()
    found = index.IndexReader(spark, str(tmp_path / "i")).lexicon().collect()
    assert {(r.field, r.term, r.doc_freq) for r in found} == {("te xt:%=1", "a", 1), ("te xt:%=1", "b", 2), ("kind", "k", 1)}
