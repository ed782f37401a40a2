"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has a bit set where over half of the document's shingle hashes have
it.  Two fingerprints link when at most ``MAX_BITS`` (4) bits differ.

The 64 bits form a ring of five segments.  With 4 differences in all, some start
segment has the property that the first l segments from it hold at most
floor(4 l / 5) differences, for each l: none in the first, at most 1 in the first
two, 2 in three, 3 in four.  The first two conditions are an equality, so they
become join keys: for each start segment and each bit of the next segment, the
two segments with that bit masked (64 keys of about 24 bits a fingerprint).  Rows
with equal keys are compared in sorted runs; the chain conditions for three and
four segments prune pairs before the full count.

Only distinct fingerprints take part, named by the least id that has them, so
copies cost nothing.  A task sends on a spanning forest of the links it found,
never all pairs.  Runs longer than ``RUN_ROWS`` pass through as they are and are
compared in a second pass, in pairs of blocks spread over tasks.

Defined results: null text and text without words have fingerprint zero and link
like any other; rows with a null id get a fingerprint and no component; rows that
repeat an id count as one document for links, each with its own fingerprint, and
a repeated id takes part with each of its fingerprints; an empty table gives an
empty result; other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut_lineage
from .components import connected_components

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Segment widths around the ring, from bit 0.
WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
#: Rows of one key compared in one place; longer runs go to the second pass.
RUN_ROWS = 4096
#: Candidate pairs handled at once.
PAIR_CHUNK = 1 << 20


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    r"""XXH64 of each run of ``words`` words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; all words where fewer."""
    line = b" ".join(text.lower().split())
    if not line:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.append(spaces, len(line))[words - 1 :].tolist()
    if not ends:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts = [0, *(spaces + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def fold_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, fp bigint"

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                texts = batch.column("t").cast(pa.binary()).to_numpy(zero_copy_only=False)
                fps = np.array([fold_bits(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fps)], names=[key, "fp"])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)


def ring_keys(fp: str = "fp"):
    """The 64 keys of a fingerprint as an array column."""
    part = [F.shiftrightunsigned(F.col(fp), o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in zip(OFFSETS, WIDTHS, strict=True)]
    keys = []
    for i in range(len(WIDTHS)):
        after = (i + 1) % len(WIDTHS)
        head = F.shiftleft(part[i], 13)
        for j in range(WIDTHS[after]):
            mask = ((1 << WIDTHS[after]) - 1) & ~(1 << j)
            keys.append(F.lit((16 * i + j) << 26).bitwiseOR(head).bitwiseOR(part[after].bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _chain_masks() -> np.ndarray:
    """For each start segment, the bits of the first three and the first four segments."""
    segment = [((1 << w) - 1) << o for o, w in zip(OFFSETS, WIDTHS, strict=True)]
    m = len(segment)
    return np.array([[sum(segment[(i + k) % m] for k in range(n)) for n in (3, 4)] for i in range(m)], np.uint64)


CHAINS = _chain_masks()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, least node of its part) for the parts that links a-b form."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label = label[label]
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


class _Links:
    """Verified links of a task, kept down to a forest."""

    def __init__(self):
        self._a, self._b, self._n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self._a.append(a)
        self._b.append(b)
        self._n += len(a)
        if self._n > PAIR_CHUNK:
            self._shrink()

    def _shrink(self) -> None:
        a, b = forest(np.concatenate(self._a), np.concatenate(self._b))
        self._a, self._b, self._n = [a], [b], len(a)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._shrink()
        out = self._a[0], self._b[0]
        self._a, self._b, self._n = [], [], 0
        return out


def _verify(fps: np.ndarray, starts: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pass the chain conditions and the full count."""
    different = fps[x] ^ fps[y]
    if starts is not None:
        chain = CHAINS[starts[x]]
        ok = (np.bitwise_count(different & chain[:, 0]) <= 2) & (np.bitwise_count(different & chain[:, 1]) <= 3)
        x, y, different = x[ok], y[ok], different[ok]
    ok = np.bitwise_count(different) <= MAX_BITS
    return x[ok], y[ok]


def compare_runs(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, starts: np.ndarray | None, links: _Links) -> None:
    """Links among rows with equal keys; rows are sorted by key."""
    n = len(keys)
    if n < 2:
        return
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), n - 1)
    end = last[np.searchsorted(last, np.arange(n))] + 1
    rows, step = np.arange(n), 1
    while True:
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            return
        for i in range(0, len(rows), PAIR_CHUNK):
            x = rows[i : i + PAIR_CHUNK]
            a, b = _verify(fps, starts, x, x + step)
            if len(a):
                links.add(nodes[a], nodes[b])
        step += 1


def _find(max_run: int | None):
    """Arrow function over rows (key, fp, node) sorted by key: (kind, a, b, c).

    kind 0: the link a-b.  kind 1: a row (key, fp, node) of a run over ``max_run``.
    """

    def out(kind: int, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])

    def run(batches):
        links = _Links()
        held: list[np.ndarray] = []  # rows of the last key so far
        n_held, passing = 0, None

        def settle(block: np.ndarray):
            keys, fps, nodes = block
            starts = None if max_run is None else (keys >> 30).astype(np.int64)
            compare_runs(keys, fps.view(np.uint64), nodes, starts, links)

        for batch in batches:
            block = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            if not block.shape[1]:
                continue
            if passing is not None:  # in the middle of a long run
                stop = int(np.searchsorted(block[0], passing, side="right"))
                if stop:
                    yield out(1, *block[:, :stop])
                if stop == block.shape[1]:
                    continue
                passing, block = None, block[:, stop:]
            block = np.concatenate([*held, block], axis=1) if held else block
            cut = int(np.searchsorted(block[0], block[0][-1], side="left"))
            ready, rest = block[:, :cut], block[:, cut:]
            if max_run is not None and cut:
                keys, counts = np.unique(ready[0], return_counts=True)
                if (counts > max_run).any():
                    far = np.isin(ready[0], keys[counts > max_run])
                    yield out(1, *ready[:, far])
                    ready = ready[:, ~far]
            settle(ready)
            held, n_held = [rest], rest.shape[1]
            if max_run is not None and n_held > max_run:
                passing = int(rest[0][0])
                yield out(1, *rest)
                held, n_held = [], 0
        if held:
            settle(held[0])
        a, b = links.flush()
        if len(a):
            yield out(0, a, b, np.zeros(len(a), np.int64))

    return run


_FOUND = "kind int, a bigint, b bigint, c bigint"


def near_links(nodes: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``MAX_BITS``; nodes has (fp, node), fp distinct."""
    keyed = nodes.select(F.explode(ring_keys()).alias("key"), "fp", "node")
    found = cut_lineage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_find(run_rows), _FOUND))
    links = found.where("kind = 0").select("a", "b")
    long_runs = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("c").alias("node"))
    if long_runs.isEmpty():
        return links
    # Each long run: blocks of about run_rows rows, each pair of blocks in one place.
    sizes = long_runs.groupBy("key").agg(F.ceil(F.count("*") / F.lit(run_rows)).cast("int").alias("blocks"))
    dealt = long_runs.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = paired.select(place.alias("key"), "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_find(None), _FOUND)
    return links.unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row; the component is the least id reachable over links."""
    printed = cut_lineage(fingerprints(docs, key, text))
    nodes = printed.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node"))
    # A repeated id with several fingerprints ties them together.
    several = printed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("f"), F.max("fp").alias("g")).where("f < g").select(key)
    ties = printed.join(several, key).join(nodes, "fp").select(F.col(key).alias("a"), F.col("node").alias("b"))
    parts = connected_components(near_links(nodes).unionByName(ties))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return printed.join(named, "fp", "left").select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the least id; null ids stay."""
    away = near_duplicates(docs, key, text).where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(away, key, "left_anti").select(docs.columns)
