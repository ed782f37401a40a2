"""Packing of tokenised documents into sequences of bounded length.

Each document becomes its token ids plus one end id, cut into pieces of at most
``capacity`` ids.  Pieces are dealt into randomised groups by a seeded hash of their
row number, so equal rows spread like any others; each
group is packed on its own by first-fit decreasing, where a tournament tree over
the bins' free space finds the first bin that fits in logarithmic time.  Only
piece descriptions are shuffled, never ids.  The number of groups follows the
row count, so a group stays at a few thousand documents at any scale; pieces of
one long document are spread over groups.

Sequences longer than their content are padded to the capacity, except where the
content is a power of two.  Defined results: null text is empty and packs its
end id alone; repeated rows are packed once each (their pieces tie, broken by
key and start); an empty table gives an empty result; other columns are dropped; a key named as an output column is refused.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, no_cycle_collection
from .words import ragged, space_parts

CAPACITY = 2048
END_ID = 1
#: Documents in a group, on average.
GROUP_DOCS = 4096
CACHE_ENTRIES = 600_000
CACHE_CHARS = 48
_TAILS = (".", ",")
#: A group's sequence ids start at its number times this.
GROUP_STRIDE = 1 << 32
OUTPUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "pack_group")


class TournamentTree:
    """Free space of bins in a complete binary tree whose nodes hold the larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the leftmost bin that has it; its number."""
        best, node = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        bin_ = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            larger = max(best[2 * node], best[2 * node + 1])
            if best[node] == larger:
                break
            best[node] = larger
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; sizes are taken largest first, ties in order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = TournamentTree(len(sizes), capacity)
    used = [0] * tree.leaves
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.first_fit(size)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
    return bins, offsets


class IdEncoder:
    """Token ids of texts under a vocabulary that drops white space.

    Ids of a text are those of its space-separated parts in order, so each
    distinct part of a batch is looked up once in a bounded cache.
    """

    def __init__(self, vocab_path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocab_path)
        self._cache: dict[str, bytes] = {}
        self._cap = cache_entries

    def _blobs(self, parts: list[str]) -> list[bytes]:
        # The vocabulary lower-cases, and a run of letters never joins a mark after it:
        # "Word," has the ids of "word" and then those of ",".  Only for ASCII letters: others
        # may end in a combining mark once lower-cased, and added tokens are matched as they stand.
        tails = [p[-1:] if p[-1:] in _TAILS else "" for p in parts]
        cores = [p[:-1] if t else p for p, t in zip(parts, tails, strict=True)]
        plain = [c.isascii() and c.isalpha() for c in cores]
        tails = [t if x else "" for t, x in zip(tails, plain, strict=True)]
        cores = [c.lower() if x else p for p, c, x in zip(parts, cores, plain, strict=True)]
        get = self._cache.get
        found = [*map(get, cores)]
        missing = {c for c, v in zip(cores, found, strict=True) if v is None}
        if missing:
            new = self._encode_new([*missing])
            found = [new[c] if v is None else v for c, v in zip(cores, found, strict=True)]
        ends = {t: np.array(self._tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in _TAILS}
        return [v + ends[t] if t else v for v, t in zip(found, tails, strict=True)]

    def _encode_new(self, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            encoded = [e.ids for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(encoded), "<u4").tobytes()
            ends = [*itertools.accumulate(map(len, encoded), initial=0)]
            out.update((p, flat[4 * a : 4 * b]) for p, a, b in zip(some, ends, ends[1:], strict=False))
        if len(self._cache) + len(out) > self._cap:
            self._cache.clear()
        self._cache.update(itertools.islice(((p, v) for p, v in out.items() if len(p) <= CACHE_CHARS), self._cap))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, where each text starts; one more at the end)."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        n = space_parts(texts, " ")
        blobs = self._blobs(n.words)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        lengths = sizes[n.codes]
        ids = ragged(np.frombuffer(b"".join(blobs), "<u4"), starts[n.codes], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[n.offsets]


@functools.cache
def _encoder(vocab_path: str) -> IdEncoder:
    return IdEncoder(vocab_path)


def pieces(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of each piece."""
    if key in OUTPUT:
        raise ValueError(f"the key must not be called {key!r}: that is an output column")
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    end = np.array([end_id], "<u4")

    def run(batches):
        encoder = _encoder(vocab_path)
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                with no_cycle_collection():
                    ids, bounds = encoder.encode(batch.column("t"))
                rows: list[tuple[int, int, int, int, int]] = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[a:b], end])
                    for s in range(0, len(own), capacity):
                        piece = own[s : s + capacity]
                        rows.append((i, s, len(piece), zlib.crc32(piece), len(own)))
                owner, *columns = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column("k"), pa.array(owner)), *map(pa.array, columns)], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """Pieces with their sequence_id and offset, and the length the sequence is padded to."""
    cut = pieces(docs, vocab_path, key, text, capacity, end_id)
    groups = max(1, -(-docs.count() // group_docs))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    names = cut.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values([key, "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        content = np.bincount(bins, weights=rows["length"], minlength=1).astype(np.int64)
        exact = (content & (content - 1)) == 0
        padded = np.where(exact, content, capacity)
        out = rows[names].copy()
        out["sequence_id"] = rows["pack_group"] * GROUP_STRIDE + bins
        out["offset"] = offsets
        out["sequence_length"] = padded[bins]
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint, sequence_length bigint"
    return dealt.groupBy("pack_group").applyInPandas(run, schema)
