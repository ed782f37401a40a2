"""Quality, toxicity and language models: held-out accuracy and defined edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.1"
EDGE = [None, "", " ", "a", "word " * 30_000, "123 !!", "x" * 50_000, "a", "a"]
SCHEMA = "doc_id long, text string, lang string, score string"


def edge_docs(spark):
    return spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(EDGE)] + [(None, "the cat", "en", "x")], SCHEMA)


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


@pytest.mark.parametrize("module,label,rows,low", [(quality, "quality", quality.SAMPLE_ROWS, 0.97), (toxicity, "toxic", toxicity.SAMPLE_ROWS, 0.96)])
def test_classifiers(spark, module, label, rows, low):
    docs, labels = tables(spark)
    model = module.train(docs, labels, rows=rows)
    rows = {r.doc_id: r for r in module.score(docs, model).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(i, 5, 0) and 0 <= r.score <= 1 for i, r in rows.items())
    pairs = [(rows[r.doc_id].predicted, r[label]) for r in labels.collect() if held_out(r.doc_id, 5, 0)]
    assert np.mean([p == y for p, y in pairs]) >= low
    assert len(set(p for p, _ in pairs)) == 2
    edge = module.score(edge_docs(spark), model).collect()
    assert len(edge) == len(EDGE) + 1 and all(0 <= r.score <= 1 for r in edge)
    by = {r.doc_id: r.score for r in edge}
    assert by[3] == by[7] == by[8] and by[0] == by[1]
    assert module.score(docs.limit(0), model).count() == 0
    nothing = module.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in module.score(edge_docs(spark), nothing).collect()} == {0.5}


def test_network_gradient_matches_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 5, 300, 900)]
    y = np.array([0, 1, 1, 0])
    net = quality.ByteConvNet(1)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        p = net.predict(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(texts, y)
    for name in ("w3", "b2", "w2", "b1", "w1a"):
        p = getattr(net, name)
        i = tuple(int(rng.integers(s)) for s in p.shape)
        keep = p[i]
        p[i] = keep + 1e-2
        up = loss()
        p[i] = keep - 1e-2
        down = loss()
        p[i] = keep
        assert abs((up - down) / 2e-2 - grads[name][i]) < 2e-2 * max(1.0, abs(grads[name][i]) * 5)


def test_chunks_cover_every_byte():
    for n in (0, 1, 7, 8, 9, 128, 129, 4000):
        at = quality.lay_out([b"x" * n, b"y"])
        assert at.half_size.sum() == len(at.blocks) == max(-(-n // 8), 1) + 1
        assert set(at.chunk_a) | set(at.chunk_b) == set(range(len(at.half_start)))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{rng.integers(10**6)}" for _ in range(30)) + (" badword" if i % 2 else "") for i in range(300)]
    w = toxicity.fit(texts, np.arange(300) % 2)
    assert 1 <= len(w.slots) < 50
    scores = toxicity.score_batch(pa.array(["a badword b", "nothing here"]), w.dense(), w.bias)
    assert scores[0] > 0.5 > scores[1]


def test_language(spark):
    docs, _ = tables(spark)
    model = language_id.train(docs, rows=80)
    rows = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    known = [(r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect() if held_out(r.doc_id, 4, 2)]
    assert np.mean([rows[i].lang_pred == y for i, y in known]) > 0.97
    assert all(r.held_out == held_out(i, 4, 2) for i, r in rows.items())
    edge = {r.doc_id: r for r in language_id.predict(edge_docs(spark), model).collect()}
    assert len(edge) == len(EDGE) + 1
    for i, t in enumerate(EDGE):
        assert (edge[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= edge[i].score <= 1
    words = model.label_words("the of and that with this und der die das ist nicht")
    assert [w for w, _ in words] == "the of and that with this und der die das ist nicht".split()
    assert {lang for w, lang in words if w in ("the", "and")} == {"en"} and {lang for w, lang in words if w in ("und", "der", "die")} == {"de"}
    kept = language_id.keep_languages(edge_docs(spark), model)
    assert kept.columns == edge_docs(spark).columns
    assert 0 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id = 4").count() == 1
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(edge_docs(spark), nothing).collect()} == {"und"}


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    field = language_id.ChainField(["a", "b", "c"])
    field.moves = rng.standard_normal((3, 3))
    field.start = rng.standard_normal(3)
    e = rng.standard_normal((4, 1, 3))
    post, expected = field.posteriors(np.exp(e), np.ones((4, 1), bool))
    import itertools

    total, single, pair = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(field.start[path[0]] + sum(e[t, 0, s] for t, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, s in enumerate(path):
            single[t, s] += w
        for a, b in zip(path, path[1:], strict=False):
            pair[a, b] += w
    assert np.allclose(post[:, 0], single / total, atol=1e-5) and np.allclose(expected, pair / total, atol=1e-5)
