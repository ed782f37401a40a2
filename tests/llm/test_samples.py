"""Training samples: whole texts of any length, bounded by their sum of bytes."""

import numpy as np
import pytest

from glyphmill.llm import quality, toxicity
from glyphmill.llm.common import bounded_texts


def test_long_texts_are_learned_from(spark):
    """Every text of label 1 is longer than 6000 bytes."""
    long, short = "vile scum rot " * 700, "kind calm tree "
    docs = spark.createDataFrame([(i, f"{long if i % 2 else short} w{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        scores = {r.doc_id: r.score for r in module.score(docs, module.train(docs, labels)).collect()}
        assert len(set(scores.values())) > 1
        assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


@pytest.mark.parametrize("separate", [False, True])
def test_sample_ends_with_its_bytes(spark, separate):
    texts = {i: "é" * (5000 if i % 10 == 0 else 20) + str(i) for i in range(400)}
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in texts.items()] + [(1000, None, 1)], "doc_id long, text string, y int")
    labels = docs.select("doc_id", "y") if separate else None
    take = lambda n, size: bounded_texts(docs, "doc_id", "text", None if separate else "y", n, size, labels)
    assert sorted(take(1000, 1 << 30)["t"]) == sorted(texts.values())
    assert take(30, 1 << 30).groupby("y").size().max() <= 30
    for y, own in take(1000, 30_000).groupby("y"):
        sizes = [len(t.encode()) for t in own["t"]]
        assert sum(sizes[:-1]) < 30_000 and (sum(sizes) >= 30_000 or len(sizes) == 200)
        assert set(own["t"]) <= set(texts.values())
    assert take(1000, 1).groupby("y").size().to_dict() == {0: 1, 1: 1}


def test_gradients_of_slices_sum_to_those_of_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    texts, y = [bytes(rng.integers(32, 127, 50 + 40 * i).astype(np.uint8)) for i in range(30)], np.arange(30) % 2
    net = quality.ByteConvNet(1)
    monkeypatch.setattr(quality, "SLICE", 500)
    sliced = net.sliced_gradients(texts, y)
    for name, g in net.gradients(texts, y).items():
        assert np.allclose(sliced[name], g, atol=1e-6, rtol=1e-3)


def test_most_frequent_values_only(spark):
    docs = spark.createDataFrame([(i, "text", f"l{min(i, 7)}") for i in range(20)], "doc_id long, text string, lang string")
    found = bounded_texts(docs, "doc_id", "text", "lang", 5, 1000, most=3)
    assert sorted(found["y"].unique()) == ["l0", "l1", "l7"] and (found["y"] == "l7").sum() == 5
