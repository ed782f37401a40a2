"""Removal of word sequences that an earlier document holds.

A window is ``window`` consecutive words.  A word goes when some window over it
has a word sequence that also starts in a document with a smaller id.

Windows are not hashed everywhere.  Positions of a difference cover modulo a
period carry an anchor, a hash of the next window - period + 1 words: two equal
windows, however they are aligned, share an anchor at a cover position of both.
Pass one finds anchors that several documents hold; pass two extends them, hashing
every full window around a shared anchor; pass three removes words.  Each pass
reads texts once and sends on hashes and ids.

A value that very many documents hold is settled where it is read: a batch keeps
for itself what its own documents already decide and sends one pair for the value,
so a hot value costs a pair for each ``PAIRS`` pairs read, not for each document.

Anchor hashes are 64 bits and only choose candidates; windows are compared by 96.

Defined results: null text has no words; rows with a null id are left as they are
and affect nothing; rows that repeat an id count as one document; an empty table
gives an empty result; ``find_repeats`` drops other columns, ``drop_repeats``
keeps them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, byte_slices, cut_lineage, parallel_partitions, release
from .words import Numbered, ascii_words

WINDOW = 50
#: Pairs of hash and document that a task holds before it sends them on.
PAIRS = 1 << 20
#: Each task sends one block to each bucket, so more buckets mean smaller blocks; a
#: bucket is what is sorted at once, so there is at least one for each ``BUCKET_BYTES``
#: of text, whatever the number of partitions.
BUCKETS_A_PARTITION = 3
BUCKET_BYTES = 128 << 20
#: Perfect difference sets, by period.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (1, 5, 11, 24, 25, 27),
}
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ROW_SCHEMA = "bucket int, open boolean, pairs binary"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def period_for(window: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max(p for p in COVERS if window - p + 1 >= max(1, window * 2 // 5))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_values(n: Numbered) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w) for w in n.words), np.uint64, len(n.words))
    return own[n.codes] if len(n.codes) else np.zeros(0, np.uint64)


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each run of ``size`` values; built by doubling."""
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    block, width, out, done = values, 1, None, 0
    rest = size
    while True:
        if rest & 1:
            if out is None:
                out, done = block, width
            else:
                m = len(values) - done - width + 1
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + block[done : done + m]
                done += width
        rest >>= 1
        if not rest:
            return out[:count]
        block = block[:-width] * np.uint64(pow(base, width, 1 << 64)) + block[width:]
        width *= 2


def _anchors(n: Numbered, values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, word position) of the anchors of texts that have a window."""
    period = period_for(window)
    size = window - period + 1
    hashes = mix(rolling(values, size, BASES[0]))
    lengths = np.diff(n.offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - n.offsets[owner]
    in_cover = np.zeros(period, bool)
    in_cover[list(COVERS[period])] = True
    take = np.flatnonzero(in_cover[at % period] & (at + size <= lengths[owner]) & (lengths[owner] >= window))
    return hashes[take], owner[take], at[take]


def _windows(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(rolling(values, window, BASES[0])), (mix(rolling(values, window, BASES[1])) >> np.uint64(32)).astype(np.uint32)


def _within(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The 64-bit name of a window inside one document."""
    return mix(h ^ mix(g.astype(np.uint64)))


class _Rows:
    """Arrow rows (bucket, open, pairs): blocks of pairs of one bucket, packed column by column.

    A shuffle of few large rows costs a fraction of one of many small rows.  Open blocks
    hold (hash, second hash, document), dealt by hash; settled ones hold (document, name)
    of what was found, dealt by document.
    """

    def __init__(self, key_type: pa.DataType, buckets: int):
        self.buckets = buckets
        self.key_type = key_type
        self.schema = pa.schema([("bucket", pa.int32()), ("open", pa.bool_()), ("pairs", pa.binary())])
        self.found = pa.schema([("k", key_type), ("many", pa.list_(pa.int64()))])

    def _blocks(self, by: np.ndarray, is_open: bool, columns: list[np.ndarray]) -> pa.RecordBatch:
        bucket = (by % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(by)]
        pairs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([is_open] * len(pairs), pa.bool_()), pa.array(pairs, pa.binary())], schema=self.schema)

    def open(self, h: np.ndarray, g: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return self._blocks(h, True, [h, g, k.astype(np.int64)])

    def settled(self, k: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return self._blocks(mix(k.astype(np.int64).view(np.uint64)), False, [k.astype(np.int64), name.view(np.int64)])

    @staticmethod
    def unpack(pairs: list[bytes], kinds: tuple[type, ...]) -> tuple[np.ndarray, ...]:
        size = sum(np.dtype(t).itemsize for t in kinds)
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        for p in pairs:
            n, at = len(p) // size, 0
            for column, t in zip(parts, kinds, strict=True):
                column.append(np.frombuffer(p, t, n, at))
                at += n * np.dtype(t).itemsize
        return tuple(map(np.concatenate, parts))

    def by_document(self, pairs: list[bytes]) -> pa.RecordBatch:
        """(k, many): one row for each document of a bucket's settled blocks."""
        k, name = self.unpack(pairs, (np.int64, np.int64))
        order = np.argsort(k, kind="stable")
        k, name = k[order], name[order]
        firsts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(k[firsts]).cast(self.key_type), pa.ListArray.from_arrays(pa.array(np.append(firsts, len(k)).astype(np.int32)), pa.array(name))], schema=self.found)


def _names(h: np.ndarray, g: np.ndarray, every: bool) -> np.ndarray:
    """What a document is told: an anchor's hash, or a window's name."""
    return h if every else _within(h, g)


def _groups(h: np.ndarray, g: np.ndarray, k: np.ndarray, every: bool):
    """Sorted distinct (value, document) pairs, the first of each value, and which are decided.

    ``every``: all documents of a value that two documents hold; else all but the
    smallest document of each value.
    """
    order = np.lexsort((k, g, h))
    h, g, k = h[order], g[order], k[order]
    new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
    again = np.append(False, ~new[1:] & (k[1:] == k[:-1]))
    h, g, k, new = h[~again], g[~again], k[~again], new[~again]
    first = np.flatnonzero(new)
    known = ~new
    if every:
        several = np.append(first[1:], len(h)) - first > 1
        known = known.copy()
        known[first[several]] = True
    return h, g, k, first, known


def _settle(rows: _Rows, parts: list[tuple[np.ndarray, ...]], every: bool):
    """Split what a task has read into settled rows and, one pair for each value, open rows."""
    h, g, k = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(h):
        return
    h, g, k, first, known = _groups(h, g, k, every)
    yield rows.open(h[first], g[first], k[first])
    if known.any():
        yield rows.settled(k[known], _names(h[known], g[known], every))


def _gather(rows: _Rows, pairs, every: bool):
    """Collect pairs of a task's batches, ``PAIRS`` at a time, and settle them."""
    held, count = [], 0
    for part in pairs:
        held.append(part)
        count += len(part[0])
        if count >= PAIRS:
            yield from _settle(rows, held, every)
            held, count = [], 0
    if held:
        yield from _settle(rows, held, every)


def _by_bucket(batches):
    """Blocks of one bucket at a time, from rows sorted by bucket."""
    current, held = None, []
    for batch in batches:
        for bucket, pairs in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_numpy(zero_copy_only=False), strict=True):
            if bucket != current and held:
                yield held
                held = []
            current = bucket
            held.append(pairs)
    if held:
        yield held


def _decide(rows: _Rows, every: bool):
    """Arrow function over rows sorted by bucket: settled blocks, passed on or newly found."""

    def run(batches):
        passed: list[pa.RecordBatch] = []

        def open_only():
            for batch in batches:
                is_open = batch.column("open")
                passed.append(batch.filter(pc.invert(is_open)))
                yield batch.filter(is_open)

        # What is found in the task's buckets is handed on together.
        found, count = [], 0
        for held in _by_bucket(open_only()):
            yield from passed
            passed.clear()
            h, g, k, _, known = _groups(*rows.unpack(held, (np.uint64, np.uint32, np.int64)), every)
            found.append((k[known], _names(h[known], g[known], every)))
            count += len(found[-1][0])
            if count >= PAIRS:
                yield rows.settled(*map(np.concatenate, zip(*found, strict=True)))
                found, count = [], 0
        yield from passed
        if count:
            yield rows.settled(*map(np.concatenate, zip(*found, strict=True)))

    return run


def _by_document(rows: DataFrame, spec: _Rows, every: bool, key_type: str) -> DataFrame:
    """(k, many): what was found in each document, from open and settled rows."""

    def collect(batches):
        for held in _by_bucket(batches):
            yield spec.by_document(held)

    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    decided = dealt(rows).mapInArrow(_decide(spec, every), _ROW_SCHEMA)
    return cut_lineage(dealt(decided).mapInArrow(collect, f"k {key_type}, many array<bigint>"))


def _packed(rows: DataFrame) -> DataFrame:
    """The text column t as Zstandard frames: texts move twice, and this halves them."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "t" else f.dataType) for f in rows.schema])
    at = rows.columns.index("t")

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                packed = [pack(t) for t in batch.column("t").cast(pa.binary()).to_numpy(zero_copy_only=False)]
                yield batch.set_column(at, "t", pa.array(packed, pa.binary()))

    return rows.mapInArrow(run, schema)


def _unpacked(batches):
    """Batches with the text column t as text again."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        for batch in byte_slices(whole, "t", SLICE_BYTES // 2):
            texts = pa.array([unpack(t) for t in batch.column("t").to_numpy(zero_copy_only=False)], pa.binary()).cast(pa.string())
            yield batch.set_column(batch.schema.get_field_index("t"), "t", texts)


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    """(k, many): names of the windows to remove in each document.  rows: (k, t) without nulls."""
    key_type = rows.schema["k"].dataType.simpleString()
    arrow_types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    if key_type not in arrow_types:
        raise ValueError("the key must be an integer column")
    partitions = parallel_partitions(rows.sparkSession)
    text_bytes = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    spec = _Rows(arrow_types[key_type], max(partitions * BUCKETS_A_PARTITION, -(-text_bytes // BUCKET_BYTES)))
    period = period_for(window)

    def anchors(batches):
        def pairs():
            for whole in batches:
                for batch in byte_slices(whole, "t"):
                    n = ascii_words(batch.column("t"))
                    h, owner, _ = _anchors(n, word_values(n), window)
                    yield h, np.zeros(len(h), np.uint32), batch.column("k").to_numpy(zero_copy_only=False)[owner].astype(np.int64)

        yield from _gather(spec, pairs(), every=True)

    def windows(batches):
        def pairs():
            for batch in _unpacked(batches):
                n = ascii_words(batch.column("t"))
                values = word_values(n)
                h, owner, at = _anchors(n, values, window)
                many = batch.column("many")
                shared_of = np.repeat(np.arange(len(many)), pc.list_value_length(many).to_numpy(zero_copy_only=False))
                shared = many.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                # A document's own shared anchors: equal (document, hash) pairs.
                tag = lambda o, x: mix(x ^ mix(o.astype(np.uint64)))
                hit = np.isin(tag(owner, h), tag(shared_of, shared))
                owner, at = owner[hit], at[hit]
                lengths = np.diff(n.offsets)
                low = n.offsets[owner] + np.maximum(at - (period - 1), 0)
                high = n.offsets[owner] + np.minimum(at, lengths[owner] - window)
                ok = high >= low
                step = np.bincount(low[ok], minlength=len(values) + 1) - np.bincount(high[ok] + 1, minlength=len(values) + 1)
                starts = np.flatnonzero(np.cumsum(step)[: len(values)] > 0)
                a, b = _windows(values, window)
                owner = np.searchsorted(n.offsets, starts, side="right") - 1
                yield a[starts], b[starts], batch.column("k").to_numpy(zero_copy_only=False)[owner].astype(np.int64)

        yield from _gather(spec, pairs(), every=False)

    candidates = _by_document(rows.mapInArrow(anchors, _ROW_SCHEMA), spec, True, key_type)
    release(rows.sparkSession)
    found = _by_document(_packed(rows).join(candidates, "k").select("k", "t", "many").mapInArrow(windows, _ROW_SCHEMA), spec, False, key_type)
    del candidates
    release(rows.sparkSession)
    return found


def _removed(n: Numbered, values: np.ndarray, many: pa.Array, window: int) -> np.ndarray:
    """Flags of the words to remove, for a batch of texts with their window names."""
    gone = np.zeros(len(values) + 1, np.int32)
    has = np.flatnonzero(pc.fill_null(pc.list_value_length(many), 0).to_numpy(zero_copy_only=False))
    if len(has) and len(values) >= window:
        a, b = _windows(values, window)
        names = _within(a, b)
        for i in has:
            lo, hi = n.offsets[i], n.offsets[i + 1] - window + 1
            if hi <= lo:
                continue
            own = many[int(i)].values.to_numpy(zero_copy_only=False).view(np.uint64)
            starts = lo + np.flatnonzero(np.isin(names[lo:hi], own))
            gone[starts] += 1
            gone[starts + window] -= 1
    return np.cumsum(gone)[:-1] > 0


def _with_names(docs: DataFrame, key: str, text: str, window: int, *more) -> DataFrame:
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), *more)
    found = _repeats(rows.where(F.col("k").isNotNull()).select("k", "t"), window)
    return _packed(rows).join(found, "k", "left")


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256): kept words joined by one space, hashed."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in _unpacked(batches):
            n = ascii_words(batch.column("t"))
            gone = _removed(n, word_values(n), batch.column("many"), window)
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), n.offsets[:-1]) * (np.diff(n.offsets) > 0) if batch.num_rows else []
            digests = []
            texts = batch.column("t").cast(pa.binary())
            for i, t in enumerate(texts.to_numpy(zero_copy_only=False)):
                words = t.split()
                if removed[i]:
                    words = [w for w, g in zip(words, gone[n.offsets[i] : n.offsets[i + 1]].tolist(), strict=True) if not g]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.diff(n.offsets)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    return _with_names(docs, key, text, window).mapInArrow(run, f"{key} {key_type}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_words(text: str, gone: list[bool]) -> str:
    """``text`` without the flagged words; a run of them goes with the white space after it."""
    out, last = [], 0
    for m, g in zip(_WORD.finditer(text), gone, strict=True):
        if g:
            out.append(text[last : m.start()])
            last = m.end()
            space = re.match(r"[\x20\x09-\x0D]*", text[last:])
            last += space.end()
    return "".join([*out, text[last:]]).rstrip(" \t\n\r\x0b\x0c") if any(gone) else text


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated words; documents of which nothing is left go."""
    others = [c for c in docs.columns if c != text]
    rows = _with_names(docs, key, text, window, F.struct(*others, F.col(text).isNull().alias(".null")).alias("doc"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("t", T.StringType())])

    def run(batches):
        for batch in _unpacked(batches):
            n = ascii_words(batch.column("t"))
            gone = _removed(n, word_values(n), batch.column("many"), window)
            texts, keep = batch.column("t").to_numpy(zero_copy_only=False).tolist(), np.ones(batch.num_rows, bool)
            if gone.any():
                for i in range(batch.num_rows):
                    own = gone[n.offsets[i] : n.offsets[i + 1]]
                    if own.any():
                        texts[i] = without_words(texts[i], own.tolist())
                        keep[i] = not own.all()
            out = pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "t"])
            yield out.filter(pa.array(keep))

    done = rows.select("doc", "t", "many").mapInArrow(run, schema)
    new = F.when(~F.col("doc.`.null`"), F.col("t"))
    return done.select(*(new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
