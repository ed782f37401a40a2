"""Quality of texts by a byte-level convolutional network in numpy.

A byte becomes a learned embedding.  The first layer's filters are 16 bytes wide
and step by 8.  Their rectified outputs are averaged over chunks of 256 bytes that
overlap by half and cover the whole document; a second layer of filters reads each
chunk, is max-pooled over chunks and combined into one probability.  Texts are never
cut: a long one goes through in windows that overlap by half a chunk, with a running
maximum, so memory stays at a few times ``SLICE`` whatever its length.

Training uses a bounded sample: about ``SAMPLE_ROWS`` labelled texts of each label
short and long ones whole, outside the held-out fold; a label's sample ends with the
text that brings it to ``SAMPLE_BYTES``, if that comes first.  Scores cover whole
texts of all documents.

Defined results: null and empty texts are scored as one block of padding; rows
without a label are not learned from; with no labelled rows of both labels the
score is the share of label 1 (0.5 with none); repeated rows get equal scores;
columns other than the key and the text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, is_held_out
from .toxicity import labelled_sample

STRIDE = 8
WIDTH = 16
EMBED = 8
FILTERS = 24
CHUNK_FILTERS = 32
#: Strides in half a chunk.
HALF = 16
SAMPLE_ROWS = 1000
SAMPLE_BYTES = SAMPLE_ROWS * 6000
EPOCHS = 10
#: Bytes laid out at once; a multiple of half a chunk.
SLICE = 1 << 20
_HALF_BYTES = HALF * STRIDE


@dataclass
class Layout:
    """Bytes of a batch with each text on its own strides, one more stride after it."""

    data: np.ndarray
    blocks: np.ndarray  # strides that a filter starts at
    half_start: np.ndarray  # first of them in each half chunk
    half_size: np.ndarray
    chunk_a: np.ndarray  # the half chunks of each chunk
    chunk_b: np.ndarray
    chunk_start: np.ndarray  # first chunk of each text


def windows(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """Batches of about ``limit`` bytes: (text numbers, pieces, the stride that follows each piece).

    Pieces of one text overlap by half a chunk, so that each of its chunks is in one of them.
    """
    step = max(limit // _HALF_BYTES, 2) * _HALF_BYTES
    numbers, pieces, after, size = [], [], [], 0
    for i, text in enumerate(texts):
        a = 0
        while True:
            b = min(a + step, len(text))
            if pieces and size + b - a > step:
                yield numbers, pieces, after
                numbers, pieces, after, size = [], [], [], 0
            numbers.append(i)
            pieces.append(text[a:b])
            after.append(text[b : b + STRIDE])
            size += b - a
            if b == len(text):
                break
            a = b - _HALF_BYTES
    if pieces:
        yield numbers, pieces, after


def lay_out(texts: list[bytes], after: list[bytes] | None = None) -> Layout:
    """``after`` holds what follows a text that is a piece of a longer one; zeros follow others."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    own = np.maximum(-(-lengths // STRIDE), 1)  # strides that filters start at
    total = own + 1
    first = np.concatenate([[0], np.cumsum(total)])
    data = np.zeros(first[-1] * STRIDE, np.uint8)
    if after is not None:  # what has a follower fills its strides
        texts = [t + f for t, f in zip(texts, after, strict=True)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw):
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data[np.arange(len(raw)) + np.repeat(first[:-1] * STRIDE - begin, lengths)] = raw
    own_first = np.concatenate([[0], np.cumsum(own)])
    blocks = np.arange(own_first[-1]) + np.repeat(first[:-1] - own_first[:-1], own)
    halves = -(-own // HALF)
    half_first = np.concatenate([[0], np.cumsum(halves)])
    half_index = np.arange(half_first[-1]) - np.repeat(half_first[:-1], halves)
    half_start = np.repeat(own_first[:-1], halves) + half_index * HALF
    half_size = np.minimum(np.repeat(own_first[1:], halves) - half_start, HALF)
    chunks = np.maximum(halves - 1, 1)
    chunk_start = np.concatenate([[0], np.cumsum(chunks)])
    chunk_a = np.arange(chunk_start[-1]) - np.repeat(chunk_start[:-1], chunks) + np.repeat(half_first[:-1], chunks)
    chunk_b = np.minimum(chunk_a + 1, np.repeat(half_first[1:] - 1, chunks))
    return Layout(data, blocks, half_start, half_size, chunk_a, chunk_b, chunk_start[:-1])


class ByteConvNet:
    NAMES = ("embed", "w1a", "w1b", "b1", "w2", "b2", "w3", "b3")

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.embed = f(256, EMBED, scale=0.5)
        self.w1a, self.w1b = (f(STRIDE * EMBED, FILTERS, scale=0.15) for _ in range(2))
        self.b1 = np.zeros(FILTERS, np.float32)
        self.w2, self.b2 = f(FILTERS, CHUNK_FILTERS, scale=0.4), np.full(CHUNK_FILTERS, 0.1, np.float32)
        self.w3, self.b3 = f(CHUNK_FILTERS, scale=0.3), np.zeros(1, np.float32)
        self.constant: float | None = None

    def _forward(self, at: Layout):
        rows = self.embed[at.data].reshape(-1, STRIDE * EMBED)
        z = (rows @ self.w1a)[at.blocks] + (rows @ self.w1b)[at.blocks + 1] + self.b1
        r = np.maximum(z, 0)
        sums = np.add.reduceat(r, at.half_start, axis=0)
        both = at.chunk_a != at.chunk_b
        size = (at.half_size[at.chunk_a] + at.half_size[at.chunk_b] * both).astype(np.float32)
        mean = (sums[at.chunk_a] + sums[at.chunk_b] * both[:, None]) / size[:, None]
        h = np.maximum(mean @ self.w2 + self.b2, 0)
        pooled = np.maximum.reduceat(h, at.chunk_start, axis=0)
        return rows, z, both, size, mean, h, pooled, pooled @ self.w3 + self.b3[0]

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.zeros((len(texts), CHUNK_FILTERS), self.w3.dtype)  # rectified: nothing is below zero
        for numbers, pieces, after in windows(texts):
            pooled = self._forward(lay_out(pieces, after))[-2]
            np.maximum.at(best, numbers, pooled)
        logit = (best @ self.w3 + self.b3[0]).astype(np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        at = lay_out(texts)
        rows, z, both, size, mean, h, pooled, logit = self._forward(at)
        d = ((1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))) - y) / len(texts)).astype(np.float32)
        chunk_text = np.repeat(np.arange(len(texts)), np.diff(np.append(at.chunk_start, len(h))))
        dh = np.where((h == pooled[chunk_text]) & (h > 0), d[chunk_text, None] * self.w3, 0)
        dmean = (dh @ self.w2.T) / size[:, None]
        dsum = np.zeros((len(at.half_start), FILTERS), np.float32)
        np.add.at(dsum, at.chunk_a, dmean)
        np.add.at(dsum, at.chunk_b, dmean * both[:, None])
        half_of = np.repeat(np.arange(len(at.half_start)), at.half_size)
        dz = np.where(z > 0, dsum[half_of], 0).astype(np.float32)
        drows = np.zeros_like(rows)
        drows[at.blocks] += dz @ self.w1a.T
        drows[at.blocks + 1] += dz @ self.w1b.T
        dx = drows.reshape(-1, EMBED)
        embed = np.stack([np.bincount(at.data, weights=dx[:, c], minlength=256) for c in range(EMBED)], axis=1)
        return {
            "embed": embed, "w1a": rows[at.blocks].T @ dz, "w1b": rows[at.blocks + 1].T @ dz, "b1": dz.sum(0),
            "w2": mean.T @ dh, "b2": dh.sum(0), "w3": pooled.T @ d, "b3": d.sum(keepdims=True),
        }

    def sliced_gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """``gradients``, made over about ``SLICE`` bytes of text at a time."""
        out = dict.fromkeys(self.NAMES, 0.0)
        ends = np.cumsum([*map(len, texts)])
        for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // SLICE)) + 1):
            for k, g in self.gradients([texts[j] for j in own], y[own]).items():
                out[k] = out[k] + g * np.float32(len(own) / len(texts))
        return out

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01, seed: int = 9) -> ByteConvNet:
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        order, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(getattr(self, k), np.float64) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k), np.float64) for k in self.NAMES}
        for epoch in range(epochs):
            lr = rate * (1 - epoch / epochs)
            mixed = order.permutation(len(texts))
            for i in range(0, len(texts), batch):
                own = mixed[i : i + batch]
                step += 1
                for k, g in self.sliced_gradients([texts[j] for j in own], y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    p = getattr(self, k)
                    p -= (lr * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, modulus: int = 5, remainder: int = 0) -> ByteConvNet:
    texts, y = labelled_sample(docs, labels, label, key, text, rows, sample_bytes, modulus, remainder)
    return ByteConvNet().fit([t.encode() for t in texts], y)


def score(docs: DataFrame, model: ByteConvNet, key: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 0, threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for whole in batches:
            for batch in byte_slices(whole, "t", SLICE):
                texts = batch.column("t").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
                # Rounded: float sums differ in the last digits with a text's place in its batch.
                s = np.round(net.predict(texts), 5)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), is_held_out(key, modulus, remainder).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"{key} {key_type}, held_out boolean, score double, predicted int")
