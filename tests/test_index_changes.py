"""Changes of a stored index: keys, deletions, locks, pins, components, and hooks of one's own."""

import json
import os
import socket
import subprocess
import time

import pytest
from pyspark.sql import functions as F
from test_engine import PLAIN, frame, schema

from glyphmill.functions.similarity import Similarity, register_similarity
from glyphmill.operators.docset import DocSet
from glyphmill.operators.highlight import term_vectors
from glyphmill.operators.search import PolySearcher, Searcher, SortRule, SortSpec
from glyphmill.plans.query import ANDQuery, CustomQuery, MatchAllQuery, ORQuery, Query, RangeQuery, TermQuery, from_json, register_query
from glyphmill.plans.schema import Schema, full_text, register_comparison, string
from glyphmill.sources.index import BackgroundMerger, Folder, Indexer, IndexReader, Lock, LockError, purge
from glyphmill.sources.reader import TextSource


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, content string")


def built(spark, path, *pairs, **options):
    with Indexer(spark, path, schema(), partitions=2, **options) as w:
        w.add(rows(spark, *pairs)).commit()
    return path


def found(spark, path, text):
    return sorted(r.doc_id for r in Searcher(IndexReader(spark, path)).collect(text).collect())


def test_delete_and_add_again_in_one_session(spark, tmp_path):
    path = built(spark, f"{tmp_path}/i", (1, "old a"), (2, "b"))
    with Indexer(spark, path) as w:
        w.delete_by_doc_id(1).add(rows(spark, (1, "new a"))).commit()
    assert (found(spark, path, "new"), found(spark, path, "old"), found(spark, path, "a")) == ([1], [], [1])
    reader = IndexReader(spark, path)
    assert (reader.doc_max(), reader.del_count(), reader.doc_count()) == (3, 1, 2) and reader.fetch_doc(1).content == "new a"
    with Indexer(spark, path) as w:
        w.optimize().commit()
    merged = IndexReader(spark, path)
    assert (merged.doc_max(), merged.del_count(), merged.manifest.deletions) == (2, 0, {}) and found(spark, path, "a") == [1]


def test_keys_name_one_document(spark, tmp_path):
    path = built(spark, f"{tmp_path}/i", (1, "aa"), (2, "b"))
    for bad in (rows(spark, (1, "cc")), rows(spark, (7, "x"), (7, "y")), rows(spark, (None, "x"))):
        with pytest.raises(ValueError), Indexer(spark, path) as w:
            w.add(bad)
    with Indexer(spark, path) as w:
        w.add(rows(spark, (1, "cc"), (3, "aa")), replace=True).commit()
    assert found(spark, path, "aa") == [3] and found(spark, path, "cc") == [1]
    assert Searcher(IndexReader(spark, path)).total_hits(ANDQuery([TermQuery("content", "aa"), TermQuery("content", "cc")])) == 0


def test_partial_merges_keep_deletions_apart(spark, tmp_path):
    path = built(spark, f"{tmp_path}/i", (1, "one"), (2, "two"))
    for pair in ((3, "three"), (4, "four")):
        with Indexer(spark, path) as w:
            w.delete_by_doc_id(1).add(rows(spark, pair)).commit()
    with Indexer(spark, path) as w:
        w.add(rows(spark, (1, "one again"))).commit()
    with Indexer(spark, path, recycle=lambda live: sorted(live)[1:3]) as w:
        w.optimize(everything=False).commit()
    assert found(spark, path, "one") == [1] and found(spark, path, "again") == [1] and found(spark, path, "two three four") == [2, 3, 4]
    merger = BackgroundMerger(spark, path).prepare()
    with Indexer(spark, path) as w:
        w.add(rows(spark, (2, "two again")), replace=True).commit()
    merger.commit()
    assert found(spark, path, "two") == [2] and found(spark, path, "again") == [1, 2] and IndexReader(spark, path).doc_count() == 4


def test_stale_locks_are_cleared(spark, tmp_path):
    path = built(spark, f"{tmp_path}/i", (1, "a"))
    folder = Folder(spark, path)
    gone = subprocess.Popen(["true"])
    gone.wait()
    dead = json.dumps({"host": socket.gethostname(), "pid": gone.pid, "since": time.time()})
    folder.create("write.lock", dead)
    with Indexer(spark, path, timeout=0.0) as w:  # the crashed holder does not block
        w.add(rows(spark, (2, "b"))).commit()
    folder.create("write.lock", json.dumps({"host": "elsewhere", "pid": 1, "since": time.time() - 100}))
    with pytest.raises(LockError):
        Indexer(spark, path, timeout=0.0)
    assert Lock(folder, "write", 0.0, max_age=50).obtain().holder()["pid"] == os.getpid()
    folder.delete("write.lock")
    with Lock(folder, "write", 0.0), pytest.raises(LockError):
        BackgroundMerger(spark, path).prepare().commit(timeout=0.0)
    assert Lock(folder, "merge", 0.0).obtain()  # a merger that failed holds no lock


def test_purge_spares_open_writers_and_pinned_readers(spark, tmp_path):
    path = built(spark, f"{tmp_path}/i", (1, "a"), (2, "b"))
    writer = Indexer(spark, path).add(rows(spark, (3, "c")))
    with pytest.raises(LockError):
        purge(spark, path)
    writer.commit()
    assert found(spark, path, "a b c") == [1, 2, 3]
    old = IndexReader(spark, path)
    with old.pin():
        with Indexer(spark, path) as w:
            w.delete_by_doc_id(1).optimize().commit()
        purge(spark, path)
        assert Searcher(old).total_hits("a b c") == 3
    assert any(g.startswith("docs/") for g in purge(spark, path)) and found(spark, path, "a b c") == [2, 3]
    with Indexer(spark, path) as w:  # never committed
        w.add(rows(spark, (9, "z")))
    assert len([g for g in purge(spark, path) if g.startswith("docs/")]) == 1 and found(spark, path, "a b c") == [2, 3]


def test_components_and_codec(spark, tmp_path):
    path = f"{tmp_path}/i"
    writers = {"lengths": lambda docs: docs.select("doc_id", F.length("content").alias("n"))}
    for part in (((1, "a"), (2, "bb")), ((3, "ccc"),)):
        with Indexer(spark, path, schema(), writers=writers, codec="zstd") as w:
            w.add(rows(spark, *part)).commit()
    with Indexer(spark, path) as w:
        w.delete_by_doc_id(2).commit()
    lengths = lambda: sorted(map(tuple, IndexReader(spark, path).component("lengths").collect()))
    assert lengths() == [(1, 1), (3, 3)]
    with Indexer(spark, path) as w:
        w.optimize().commit()
    assert lengths() == [(1, 1), (3, 3)]
    segments = os.listdir(f"{path}/docs")
    assert any("zstd" in f for s in segments for f in os.listdir(f"{path}/docs/{s}"))


def test_frequent_terms_are_dealt_over_partitions(spark, tmp_path):
    path = f"{tmp_path}/i"
    with Indexer(spark, path, schema(), partitions=8) as w:
        w.add(rows(spark, *((i, f"same w{i}") for i in range(400)))).commit()
    reader = IndexReader(spark, path)
    files = reader.posting_list("content", "same").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 2 and reader.posting_list("content", "same").count() == 400
    assert reader.posting_list("content", "w7").count() == 1 and reader.doc_freq("content", "same") == 400


@register_query
class AtLeast(CustomQuery):
    """Documents that hold a term a number of times; the surplus is the score."""

    def __init__(self, term: str, times: int, boost: float = 1.0):
        self.term, self.times, self.boost = term, times, boost

    def to_json(self):
        return {"type": "AtLeast", "term": self.term, "times": self.times, "boost": self.boost}

    def needs(self, out):
        out.terms.setdefault(("content", self.term), False)
        return False

    def match(self, compiler):
        return compiler.frequency("content", self.term) >= self.times

    def score(self, compiler, boost):
        return (compiler.frequency("content", self.term) - self.times) * F.lit(boost)


class Unknown(Query):
    pass


@pytest.mark.parametrize("kind", ["texts", "index"])
def test_custom_queries(spark, tmp_path, kind):
    texts = ["a a a", "a b", "a a c", "b"]
    docs = frame(spark, texts)
    if kind == "texts":
        src = TextSource(docs, schema())
    else:
        with Indexer(spark, f"{tmp_path}/i", schema()) as w:
            w.add(docs).commit()
        src = IndexReader(spark, f"{tmp_path}/i")
    s = Searcher(src)
    query = from_json(AtLeast("a", 2).to_json())
    assert {r.doc_id: r.score for r in s.collect(query).collect()} == {0: 1.0, 2: 0.0}
    assert {r.doc_id for r in s.collect(ORQuery([query, TermQuery("content", "b")])).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in s.collect(ANDQuery([query, TermQuery("content", "c")])).collect()} == {2}
    with pytest.raises(TypeError):
        s.collect(Unknown())


class Indifferent(Similarity):
    """Matching more clauses earns nothing."""

    def coord(self, overlap, most):
        return F.lit(1.0)


class Flat(Similarity):
    def length_norm(self, n_tokens):
        return F.lit(1.0)


def test_own_similarity(spark):
    docs, query = frame(spark, ["a", "b", "a b"]), ORQuery([TermQuery("content", "a"), TermQuery("content", "b")])
    src = TextSource(docs, schema())
    scores = lambda s: {r.doc_id: r.score for r in s.collect(query).collect()}
    usual, own = scores(Searcher(src)), scores(Searcher(src, similarity=Indifferent()))
    assert own[0] == pytest.approx(2 * usual[0]) and own[2] == pytest.approx(usual[2])
    with pytest.raises(ValueError):
        full_text(PLAIN, similarity="flat")
    register_similarity("flat", Flat)
    flat = Schema().spec_field("content", full_text(PLAIN, similarity="flat"))
    by = {r.doc_id: r.score for r in Searcher(TextSource(docs, flat)).collect(TermQuery("content", "a")).collect()}
    assert by[0] == pytest.approx(by[2])


def test_own_comparison(spark, tmp_path):
    with pytest.raises(ValueError):
        string(comparison="by_length")
    register_comparison("by_length", F.length)
    fields = schema(name=string(sortable=True, comparison="by_length"))
    docs = spark.createDataFrame([(0, "v", "ccc"), (1, "v", "dddd"), (2, "v", None), (3, "v", "z")], "doc_id long, content string, name string")
    with Indexer(spark, f"{tmp_path}/i", fields) as w:
        w.add(docs).commit()
    s = Searcher(IndexReader(spark, f"{tmp_path}/i"))
    ids = lambda reverse: [r.doc_id for r in s.top_docs("v", sort=SortSpec([SortRule("field", "name", reverse)])).collect()]
    assert ids(False) == [3, 0, 1, 2] and ids(True) == [2, 1, 0, 3]
    assert {r.doc_id for r in s.collect(RangeQuery("name", "xx", "yyy")).collect()} == {0}
    assert [r.name for r in s.source.unique_values("name").collect()] == ["z", "ccc", "dddd", None]


def test_hits_of_several_indexes(spark, tmp_path):
    parts = [Searcher(IndexReader(spark, built(spark, f"{tmp_path}/{n}", *pairs))) for n, pairs in (("a", [(0, "a x"), (1, "b")]), ("b", [(0, "a a"), (1, "c")]))]
    both = PolySearcher(parts)
    assert both.offsets == [0, 2]
    hits = both.hits("a", 5).collect()
    assert [(h.doc_id, h.content) for h in hits] == [(2, "a a"), (0, "a x")] and hits[0].score > hits[1].score
    assert sorted(r.doc_id for r in both.docset("a b").ids.collect()) == [0, 1, 2]


def test_docsets(spark):
    ids = lambda *k: DocSet(spark.createDataFrame([(i,) for i in k], "doc_id long"), "doc_id").persist()
    keys = lambda s: sorted(r.doc_id for r in s.ids.collect())
    a, b, all_ = ids(1, 2, 3), ids(2, 3, 9), ids(*range(10))
    assert (keys(a & b), keys(a | b), keys(a ^ b), keys(a - b)) == ([2, 3], [1, 2, 3, 9], [1, 9], [1])
    assert keys(a.flipped(all_)) == [0, 4, 5, 6, 7, 8, 9] and a.count() == 3 and (b.next_from(4), b.next_from(10)) == (9, None)
    s = Searcher(TextSource(frame(spark, ["x"] * 10), schema()))
    assert sorted(r.doc_id for r in s.top_docs(MatchAllQuery(), within=a & b).collect()) == [2, 3]


def test_term_vectors(spark):
    got = {(r.doc_id, r.term): (r.positions, r.starts, r.ends) for r in term_vectors(frame(spark, ["a bé a", None, "é"]), schema(), "content").collect()}
    assert got == {(0, "a"): ([0, 2], [0, 5], [1, 6]), (0, "bé"): ([1], [2], [4]), (2, "é"): ([0], [0], [1])}
