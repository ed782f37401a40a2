"""Toxicity by logistic regression, trained with FTRL-proximal over hashed features.

Features of a text are its distinct words, neighbouring pairs, and skip-grams
(pairs with one or two words between), lower-cased and hashed into ``2**BITS``
slots.  FTRL-proximal keeps a learning rate for each coordinate and an L1 term,
so most weights are exactly zero; what is left is broadcast as (slot, weight)
arrays and can never exceed ``2**BITS`` entries.

Training uses a bounded sample: about ``SAMPLE_ROWS`` labelled texts of each
label, short and long ones whole, outside the held-out fold; a label's sample ends
with the text that brings it to ``SAMPLE_BYTES``, if that comes first.
Scores cover whole texts of all documents.

Defined results: null and empty texts have no features and get the score of the
bias; rows without a label are not learned from; with no labelled rows of both
labels the score is the prior (0.5 with none); repeated rows get equal scores;
columns other than the key and the text are dropped.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, byte_slices, is_held_out
from .decontamination import normal_words

BITS = 20
SAMPLE_ROWS = 6000
SAMPLE_BYTES = SAMPLE_ROWS * 8000
#: Text bytes whose features are made at once in training.
FIT_BYTES = 1 << 20
EPOCHS = 3
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.  One text moves a slot by
#: less than 1 an epoch, so with L1 = epochs a feature of one text alone stays at zero.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
_SHIFTS = (0, 1, 2, 3)


@dataclass
class Weights:
    slots: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.values
        return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every feature occurrence in a batch without nulls."""
    n = normal_words(pc.utf8_lower(texts))
    if not len(n.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    own = np.fromiter((zlib.crc32(w.encode()) for w in n.words), np.uint32, len(n.words))
    h = own[n.codes].astype(np.uint64)
    owner = np.repeat(np.arange(len(n.offsets) - 1), np.diff(n.offsets))
    owners, slots = [], []
    for shift in _SHIFTS:
        if shift == 0:
            x, o = h, owner
        else:
            same = owner[shift:] == owner[:-shift]
            x = (h[:-shift] * np.uint64(0x9E3779B97F4A7C15 + 2 * shift) ^ h[shift:] * np.uint64(0xC2B2AE3D27D4EB4F))[same]
            o = owner[shift:][same]
        x = x * np.uint64(0xFF51AFD7ED558CCD + 2 * shift)
        slots.append((x >> np.uint64(64 - BITS)).astype(np.uint32))
        owners.append(o)
    return np.concatenate(owners), np.concatenate(slots)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss with binary features."""

    def __init__(self, slots: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        # The last coordinate is the bias; it has no L1 term.
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, at: np.ndarray, y: float) -> None:
        """One example: ``at`` are its distinct slots."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self) -> Weights:
        w = self.weights(np.arange(len(self.z)))
        slots = np.flatnonzero(w[:-1])
        return Weights(slots.astype(np.int32), w[slots].astype(np.float32), float(w[-1]))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Weights:
    if not len(texts) or len(set(labels.tolist())) < 2:
        p = (np.sum(labels) + 1) / (len(labels) + 2)
        return Weights(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(p / (1 - p))))
    distinct: list[np.ndarray] = []  # the slots of each text
    for some in byte_slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]), "t", FIT_BYTES):
        owner, slots = features(some.column("t"))
        pairs = np.unique(owner.astype(np.int64) << BITS | slots)
        cuts = np.searchsorted(pairs >> BITS, np.arange(1, some.num_rows))
        distinct += np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), cuts)
    model, order = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(texts)).tolist():
            model.learn(distinct[i], float(labels[i]))
    return model.sparse()


def score_batch(texts: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    owner, slots = features(texts)
    heavy = np.flatnonzero(dense[slots])
    pairs = np.unique(owner[heavy].astype(np.int64) << BITS | slots[heavy])
    total = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(texts))
    return _sigmoid(total + bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int, sample_bytes: int, modulus: int, remainder: int):
    """A bounded training sample of both labels, outside the held-out fold, as (text, label)."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~is_held_out(key, modulus, remainder))
    found = bounded_texts(docs.where(~is_held_out(key, modulus, remainder)), key, text, None, rows, sample_bytes, known)
    return found["t"].tolist(), found["y"].to_numpy(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, modulus: int = 5, remainder: int = 0) -> Weights:
    texts, y = labelled_sample(docs, labels, label, key, text, rows, sample_bytes, modulus, remainder)
    return fit(texts, y)


def score(docs: DataFrame, model: Weights, key: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 0, threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        dense, bias = shared.value.dense(), shared.value.bias
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                s = score_batch(batch.column("t"), dense, bias)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), is_held_out(key, modulus, remainder).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"{key} {key_type}, held_out boolean, score double, predicted int")
