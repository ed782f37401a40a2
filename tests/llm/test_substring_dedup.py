"""Substring dedup against a plain version over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from glyphmill.llm import substring_dedup as sd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words string"


def plain(docs, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("period", sd.COVERS)
def test_covers(period):
    cover = sd.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_rolling_hash_depends_on_its_run_only():
    values = np.arange(40, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 5, 20, 40):
        h = sd.rolling(values, size, sd.BASES[0])
        assert len(h) == 40 - size + 1
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(values[i : i + size].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)
    assert len(sd.rolling(values, 41, sd.BASES[0])) == 0


@pytest.mark.parametrize("window,partitions", [(1, 3), (5, 1), (8, 4), (50, 4)])
def test_against_all_windows(spark, window, partitions):
    rng = random.Random(window)
    texts = [None, "", " \n\t", "a", "a " * 70, "a " * 20_000]
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(window + rng.randrange(12))) for _ in range(6)]
    for i in range(80):
        body = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(2 * window + 6))]
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice(shared) if i % 3 else shared[0])
        texts.append(rng.choice([" ", "\n", "  "]).join(body))
    texts += texts[10:30]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs] + [(None, texts[8], "x")], SCHEMA).repartition(partitions)
    expected = plain(docs, window)
    got = result(sd.find_repeats(df, window=window))
    untouched = got.pop(None)
    assert untouched[1] == 0
    assert got == expected
    kept = sd.drop_repeats(df, window=window)
    assert kept.columns == df.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows.pop(None) == texts[8]
    assert set(rows) == {i for i, (n, g, _) in expected.items() if not n or g < n}
    for i, t in rows.items():
        assert hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() == expected[i][2]
        if not expected[i][1]:
            assert t == dict(docs)[i]


def test_documents_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert result(sd.find_repeats(docs)) == expected
    assert any(g for _, g, _ in expected.values())
    assert sd.find_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_count_as_one_document(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "z a b c d e", "x")], SCHEMA)
    got = sorted((r.doc_id, r.n_removed) for r in sd.find_repeats(df, window=5).collect())
    assert got == [(1, 0), (1, 0), (2, 5)]
