"""Benchmark decontamination with a generalised suffix automaton of test items.

Texts are lower-cased (A-Z) and cut into words.  The automaton of all items is
built from word numbers; a document's words stream through it and the longest
match ending at each word is tracked.  A match of ``window`` words, or of a whole
shorter item, is an occurrence; the state reached names the items.

Only the item side is broadcast, in blocks of about ``BLOCK_WORDS`` item words, each
built by a task; with more items the documents pass once for each block, and the
passes' spans are joined in the rows themselves, so memory stays bounded.  Before streaming, each
batch drops words that no item has and word pairs that no item has: no match can
cross them, so runs between them are streamed alone, and runs shorter than the
shortest window are skipped.

Defined results: null text has no words; null or repeated ids are kept, one row
each; null item texts and items without words never occur; items with a null id
count as text "null"; empty tables give empty results or clean documents; other
columns of the documents are kept by ``remove_contamination`` and dropped by
``find_contamination``.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, cut_lineage
from .words import Numbered, number, without

WINDOW = 10
#: Item words in one broadcast automaton.
BLOCK_WORDS = 400_000
#: For whole-text use: ASCII other than 0-9, a-z becomes a space, A-Z becomes a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(texts: pa.Array) -> pa.Array:
    """All bytes of a text array without nulls through the fold table, in one pass."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4)
    body = memoryview(data)[o[0] : o[-1]].tobytes() if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((o - o[0]).astype(np.int32)), pa.py_buffer(body.translate(_FOLD)))


def normal_words(texts: pa.Array) -> Numbered:
    n = number(pc.ascii_split_whitespace(folded(texts)))
    return without(n, np.fromiter((not w for w in n.words), bool, len(n.words)))


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that reach it through p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """Longest suffix of (current match + c) that is in some item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (to, matched + 1) if to is not None else (0, 0)

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n words of a match that ended in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


class ItemIndex:
    """Automaton of items, and which items each window state belongs to."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        number_of = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        sequences = [(i, [number_of(w) for w in words]) for i, words in items if words]
        self.words = pa.array([*self.vocabulary], pa.string())
        pairs = {(a, b) for _, s in sequences for a, b in zip(s, s[1:], strict=False)}
        size = max(len(self.vocabulary), 1)
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self.automaton = SuffixAutomaton()
        for _, s in sequences:
            self.automaton.add(s)
        #: window state → items; for each shorter length its own table.
        self.at: dict[int, dict[int, set[str]]] = {}
        for item, s in sequences:
            n = min(window, len(s))
            table = self.at.setdefault(n, {})
            state, matched = 0, 0
            for k, c in enumerate(s):
                state, matched = self.automaton.step(state, matched, c)
                if k + 1 >= n:
                    table.setdefault(self.automaton.at_length(state, n), set()).add(item)
        self.shortest = min(self.at, default=window)

    def occurrences(self, codes: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: (start, end) of the occurring windows in words of the text, and their items."""
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not len(codes) or not self.at:
            return found
        known = codes >= 0
        joined = known[1:] & known[:-1]
        candidates = np.flatnonzero(joined)
        pair = codes[candidates].astype(np.int64) * len(self.vocabulary) + codes[candidates + 1]
        joined[candidates] = np.isin(pair, self.pairs)
        inner = offsets[1:-1]
        joined[inner[(inner > 0) & (inner < len(codes))] - 1] = False
        # Runs of known words whose neighbouring pairs all occur in items.
        begins = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        ends = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long_ = ends - begins >= self.shortest
        owners = np.searchsorted(offsets, begins[long_], side="right") - 1
        lengths = sorted(self.at)
        for a, b, i in zip(begins[long_].tolist(), ends[long_].tolist(), owners.tolist(), strict=True):
            state, matched = 0, 0
            base = int(offsets[i])
            for p, c in enumerate(codes[a:b].tolist(), a):
                state, matched = self.automaton.step(state, matched, c)
                for n in lengths:
                    if n > matched:
                        break
                    items = self.at[n].get(self.automaton.at_length(state, n))
                    if items:
                        spans, names = found.setdefault(i, ([], set()))
                        spans.append((p + 1 - n - base, p + 1 - base))
                        names |= items
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[bytes]:
    """Pickled indexes of about ``block_words`` words each: built by tasks, handed over one at a time.

    Items are dealt into blocks by a hash, so many items of one id spread as well.
    """
    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def sized(batches):
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(normal_words(batch.column("t")).offsets))], names=["k", "t", "n"])

    counted = named.mapInArrow(sized, "k string, t string, n bigint").where("n > 0")
    blocks = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // block_words))

    def build(group: pa.Table) -> pa.Table:
        number_, rows = group.column("block")[0].as_py(), []
        for k, t in zip(group.column("k").to_pylist(), group.column("t").to_pylist(), strict=True):
            words = normal_words(pa.array([t]))
            rows.append((k, [words.words[c] for c in words.codes]))
        return pa.table({"block": pa.array([number_], pa.int32()), "index": pa.array([pickle.dumps(ItemIndex(rows, window))], pa.binary())})

    dealt = counted.select("k", "t", F.pmod(F.xxhash64("k", "t"), F.lit(blocks)).cast("int").alias("block"))
    built = cut_lineage(dealt.groupBy("block").applyInArrow(build, "block int, index binary"))
    for b in range(blocks):
        row = built.where(F.col("block") == b).first()
        yield row["index"] if row else pickle.dumps(ItemIndex([], window))


@functools.lru_cache(2)
def _unpickled(data: bytes) -> ItemIndex:
    return pickle.loads(data)


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def annotate(docs: DataFrame, items: DataFrame, keep: list[str], text: str, finish: Callable[[str, list[tuple[int, int]]], str] | None = None, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, t, n_words, spans, items): the kept columns in a struct, spans of words and items found.

    The text comes back as ``finish(text, spans)`` where there are spans; without
    ``finish`` it does not come back.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(items, item_key, item_text, window, block_words)
    index = next(blocks)
    while index is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared, last=following is None):
            index = _unpickled(shared.value)
            span_type, name_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())
            for whole in batches:
                for batch in byte_slices(whole, "t"):
                    texts = batch.column("t")
                    n = normal_words(texts)
                    lookup = pc.index_in(pa.array(n.words, pa.string()), index.words).fill_null(-1).to_numpy(zero_copy_only=False)
                    found = index.occurrences(lookup[n.codes], n.offsets)
                    s, m = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                    for i, (new, names) in found.items():
                        s[i] = [{"a": a, "b": b} for a, b in merged([*((x["a"], x["b"]) for x in s[i]), *new])]
                        m[i] = sorted({*m[i], *names})
                    if last and finish is None:
                        texts = pa.nulls(batch.num_rows, pa.string())
                    elif last and any(s):
                        texts = pa.array([finish(t, [(x["a"], x["b"]) for x in own]) if own else t for t, own in zip(texts.to_numpy(zero_copy_only=False), s, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc"), texts, pa.array(np.diff(n.offsets)), pa.array(s, span_type), pa.array(m, name_type)], names=["doc", "t", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
        if following is not None:
            rows = cut_lineage(rows)
            shared.destroy()
        index = following
    return rows


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, item_ids, spans, coverage) for every document."""
    rows = annotate(docs, items, [key], text, **options)
    return rows.select(F.col("doc")[key].alias(key), "n_words", _n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.array_sort("items").alias("item_ids"), "spans").withColumn("coverage", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def remove_contamination(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5, min_span: int = 1, **options) -> DataFrame:
    """``docs`` without contaminated spans of at least ``min_span`` words.

    A document whose hit words exceed ``max_coverage`` of its words is dropped.
    """

    def finish(text: str, spans: list[tuple[int, int]]) -> str:
        return cut_words(text, [(a, b) for a, b in spans if b - a >= min_span])

    others = [c for c in docs.columns if c != text]
    rows = annotate(docs.withColumn(".null", F.col(text).isNull()), items, [*others, "`.null`"], text, finish, **options)
    rows = rows.where(_n_hit() <= F.col("n_words") * F.lit(max_coverage))
    new = F.when(~F.col("doc.`.null`"), F.col("t"))
    return rows.select(*(new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def items_digest(ids: str = "item_ids") -> Column:
    return F.sha2(F.concat_ws(",", ids).cast("binary"), 256)
