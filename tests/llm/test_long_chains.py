"""Language of texts longer than a stretch of chain words: as one uncut chain."""

import numpy as np
import pyarrow as pa

from glyphmill.llm import language_id


def field():
    rng = np.random.default_rng(7)
    out = language_id.ChainField(["a", "b", "c"])
    out.weights = (rng.standard_normal(out.weights.shape) * 0.2).astype(np.float32)
    out.moves, out.start = rng.standard_normal((3, 3)) * 2, rng.standard_normal(3)
    return out


def test_posteriors_are_those_of_the_uncut_chain():
    own, rng = field(), np.random.default_rng(1)
    texts = [" ".join(f"w{x}q" for x in rng.integers(0, 60, n)) for n in (1, 63, 64, 65, 129, 300)] + [""]
    best, score = own.label_batch(pa.array(texts))
    for i, text in enumerate(texts[:-1]):
        n = len(text.split())
        whole = language_id.cut_chains(language_id.lowered(pa.array([text])), chain=n)
        post, _ = own.posteriors(own._potentials(whole, own.emissions(*language_id.word_features(whole.words)))[0], np.ones((n, 1), bool))
        assert best[i] == post[:, 0].mean(0).argmax() and abs(score[i] - post[:, 0].mean(0).max()) < 1e-4
        assert [x for _, x in own.label_words(text)] == ["abc"[k] for k in post[:, 0].argmax(1)]


def test_expected_moves_over_cuts():
    own, e = field(), np.exp(np.random.default_rng(2).standard_normal((12, 1, 3))).astype(np.float32)
    whole, moves = own.posteriors(e, np.ones((12, 1), bool))
    lanes = e.reshape(3, 4, 3).transpose(1, 0, 2)
    post, expected = own.posteriors(lanes, np.ones((4, 3), bool), np.array([False, True, True]))
    assert np.allclose(post.transpose(1, 0, 2).reshape(12, 3), whole[:, 0], atol=1e-5) and np.allclose(expected, moves, atol=1e-4)


def test_later_parts_of_texts_are_learned_from(spark):
    head = "licence terms apply here " * 200
    docs = spark.createDataFrame([(i, head + ("der hund und die katze " if i % 2 else "le chien et la chatte ") * 200, "de" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert [x for _, x in model.label_words("der hund und die katze")] == ["de"] * 5
    assert [x for _, x in model.label_words("le chien et la chatte")] == ["fr"] * 5
