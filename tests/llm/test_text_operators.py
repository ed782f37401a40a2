"""Token counts, packing, SimHash, decontamination and WARC against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from glyphmill.llm import components, decontamination, packing, simhash, token_counts, warc

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string"

AWKWARD = [None, "", " ", "a", " a  b", "a\n\nb \n c", "\x00 x", "<|endoftext|> a <|endoftext|>", "a b  c", "a\x1c b", "don't we'll  \t\n", "x" * 9000, "word " * 5000, "Éa, b.", "wörd. Wörd, WORD."]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts, first)], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_token_counts(spark):
    texts = AWKWARD + [r.text for r in documents(spark).select("text").collect()]
    exact = [len(e) for e in Tokenizer.from_file(BYTE_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_counts.count_tokens(frame(spark, texts), BYTE_BPE, limit=100).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_tokens for i in range(len(texts))] == exact
    assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (exact[i] > 100) for i, t in enumerate(texts))
    assert token_counts.count_tokens(frame(spark, []), BYTE_BPE).count() == 0


def test_token_counts_with_a_tiny_cache():
    import pyarrow as pa

    counter = token_counts.PartCounter(BYTE_BPE, cache_entries=3)
    texts = ["a b c d e f g", "h i a b c", "z, y. x"] * 3
    exact = [len(e) for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(pa.array([t]))[0] for t in texts] == exact


def test_packing_round_trip(spark):
    texts = AWKWARD + [r.text for r in documents(spark).select("text").collect()]
    ids = [[*e.ids, 1] for e in Tokenizer.from_file(WORD_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = packing.pack(frame(spark, texts), WORD_BPE, group_docs=50).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and own[0].sequence_length in (at, 2048)
    assert packing.pack(frame(spark, []), WORD_BPE).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    sizes = np.array([rng.randint(1, 100) for _ in range(400)])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= sizes[i]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("run_rows", [4096, 8])
def test_simhash_components(spark, run_rows, monkeypatch):
    monkeypatch.setattr(simhash, "near_links", lambda nodes, f=simhash.near_links: f(nodes, run_rows))
    rng = random.Random(5)
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    texts = AWKWARD + ["ÄB c", "äb c"]
    for _ in range(120):
        words = list(base) * 4
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(base)
        texts.append(" ".join(words))
    docs = frame(spark, texts, 7).unionByName(spark.createDataFrame([(None, "a b", "x"), (9, "one", "x")], DOCS))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    whole = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [(i, plain_fingerprint(t)) for i, t in whole]
    assert sorted((str(i), f) for i, f in fps) == sorted((str(r.doc_id), r.fp % 2**64) for r in rows)
    known = [(i, f) for i, f in fps if i is not None]
    links = [(a, b) for (a, f), (b, g) in itertools.combinations(known, 2) if (f ^ g).bit_count() <= 4]
    expected = plain_components({i for i, _ in known}, links)
    assert all(r.component_id == expected.get(r.doc_id) for r in rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(i for i, c in expected.items() if i == c)}


def test_simhash_on_documents(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in documents(spark).collect()}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    expected = plain_components(fps, links)
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in rows} == {i: (fps[i], expected[i]) for i in fps}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5001 + i) for i in range(100)] + [(4, 4), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == plain_components({x for p in real for x in p}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_contamination(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_decontamination(spark, block_words):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(12)] + [(12, None), (13, "!!"), (14, "the Only one")]
    texts = AWKWARD + [" ".join(rng.choice("ab cd ef gh ij AB".split()) for _ in range(60)) for _ in range(20)] + [f"x-{t}, {t} y" for _, t in items] + ["The only ONE", "only one", "ab\x00cd"]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.find_contamination(docs, bench, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].n_words, rows[i].n_hit, rows[i].item_ids) == plain_contamination(t, items), t
    cleaned = decontamination.remove_contamination(docs, bench, max_coverage=1.0, block_words=block_words)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        if not rows[r.doc_id].n_hit:
            assert r.text == texts[r.doc_id]
        else:
            assert plain_contamination(r.text, [])[0] == rows[r.doc_id].n_words - rows[r.doc_id].n_hit
    assert decontamination.find_contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_decontamination_on_documents(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = {r.doc_id: r for r in decontamination.find_contamination(documents(spark), bench).collect()}
    for d in documents(spark).collect():
        assert (rows[d.doc_id].n_words, rows[d.doc_id].n_hit, rows[d.doc_id].item_ids) == plain_contamination(d.text, items)
    assert any(r.n_hit for r in rows.values())


PAGES = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark, tmp_path):
    big = "<p>same</p>" * 40
    pages = [(3, "http://a/\n b", big, "x"), (1, None, big, "x"), (2, "http://b", "small", "x"), (4, "http://c", "small", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (None, "u", big, "x"), (7, "ü", "é" * 50, "x"), (8, "v", "é" * 50, "x"), (1, None, big, "x"), (9, "w", "z" * 300_000, "x")]
    df = spark.createDataFrame(pages, PAGES)
    rows = warc.archive_and_read(df).collect()
    expected = []
    for key, _, html, _ in pages:
        data = (html or "").encode()
        first = min((k for k, _, h, _ in pages if k is not None and (h or "").encode() == data), default=None)
        revisit = key is not None and len(data) >= 100 and key > first
        expected.append((str(key), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, expected)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_archives_have_a_dictionary_and_whole_payloads(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").coalesce(1)
    target = f"file://{tmp_path}/w"
    files = warc.write_archives(pages, target).collect()
    data = open(files[0].path, "rb").read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert sum(1 for _ in warc.iter_records(data)) == files[0].n_records + 1
    got = {r.key: bytes(r.payload).decode() for r in warc.read_archives(spark, target, with_payload=True).where("record_type = 'response'").collect()}
    assert got == {str(r.page_id): r.html for r in pages.collect() if str(r.page_id) in got}
