"""Token counts of whole texts under a byte-level BPE vocabulary.

Batches are balanced by bytes and only lengths leave the Arrow function.  Long
texts are split at *safe boundaries*: a single space or newline between two
characters that are certainly not white space.  The vocabulary's pre-tokenizer
always starts a new piece there, and merges never cross pieces, so counts of
parts add up to the count of the whole text.  Parts are words, and words repeat,
so each worker keeps a bounded cache of part lengths and hands the tokenizer
only parts it has not seen.

Defined results: null and empty text give 0 bytes, 0 tokens; repeated rows and
equal ids give one output row each; an empty table gives an empty result;
columns other than the key and the text are dropped, so none can clash.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, no_cycle_collection
from .words import space_parts

#: Entries of a worker's part cache; it is emptied when full.
CACHE_ENTRIES = 600_000
#: Longer parts are encoded each time.
CACHE_CHARS = 48
#: Marks that are one token of their own after a letter.
_TAILS = (".", ",")
#: Characters that might be white space to one regular-expression engine or another.
_ODD = "\\s\x1c-\x1f\x85\u180e\u200b\ufeff\x00"
_SAFE = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
_ODD_CHAR = re.compile(f"[{_ODD}]")


class PartCounter:
    """Counts tokens by summing over parts cut at safe boundaries."""

    def __init__(self, vocab_path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocab_path)
        self._cache: dict[str, int] = {}
        self._cap = cache_entries

    def _lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), 20_000):
            out += map(len, self._tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False))
        return out

    def _part_lengths(self, parts: list[str]) -> np.ndarray:
        """Token counts of distinct parts with their leading space or newline; -1 where an end is not safe."""
        # Letters never join a mark after them: " word," counts as " word" and ",".
        tails = [p[-1:] in _TAILS and p[:-1].isalpha() for p in parts]
        cores = [p[:-1] if t else p for p, t in zip(parts, tails, strict=True)]
        found = [*map(self._cache.get, cores)]
        missing = {c for c, v in zip(cores, found, strict=True) if v is None}
        if missing:
            new = self._count_new([*missing])
            found = [new[c] if v is None else v for c, v in zip(cores, found, strict=True)]
        return np.array(found, np.int64) + np.array(tails, np.int64)

    def _count_new(self, parts: list[str]) -> dict[str, int]:
        bodies = [p[1:] if p[:1] == "\x00" else p for p in parts]
        odd = [not b or bool(_ODD_CHAR.match(b[0]) or _ODD_CHAR.match(b[-1])) for b in bodies]
        plain = [p for p, o in zip(parts, odd, strict=True) if not o]
        out = {p: -9 for p, o in zip(parts, odd, strict=True) if o}
        out.update(zip(plain, self._lengths(["\n" + p[1:] if p[0] == "\x00" else " " + p for p in plain]), strict=True))
        if len(self._cache) + len(out) > self._cap:
            self._cache.clear()
        self._cache.update(itertools.islice(((p, v) for p, v in out.items() if len(p) <= CACHE_CHARS), self._cap))
        return out

    def _by_safe_cuts(self, text: str) -> int:
        """For texts with runs of white space: cut by pattern and count chunks of some kB."""
        first, *rest = _SAFE.split(text)
        chunks, current, size = [], [first], len(first)
        for p in rest:
            if size > 16_384:
                chunks.append(" ".join(current))
                current, size = [""], 0
            current.append(p)
            size += len(p) + 1
        chunks.append(" ".join(current))
        return sum(self._lengths(chunks))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of an Arrow array of texts without nulls."""
        if not len(texts):
            return np.zeros(0, np.int64)
        n = space_parts(texts, " \x00")
        values = self._part_lengths(n.words)[n.codes]
        heads = n.offsets[:-1]
        head_parts = [n.words[c] for c in n.codes[heads]]
        bad_ends = np.fromiter((not h or bool(_ODD_CHAR.match(h[-1])) for h in head_parts), bool, len(heads))
        values[heads] = np.where(bad_ends, -1, 0)
        sums = np.concatenate([[0], np.cumsum(values)])
        bad = np.concatenate([[0], np.cumsum(values < 0)])
        out = sums[n.offsets[1:]] - sums[heads]
        unsafe = bad[n.offsets[1:]] > bad[heads]
        unsafe |= pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        safe = np.flatnonzero(~unsafe)
        out[safe] += np.array(self._lengths([head_parts[i] for i in safe]), np.int64)
        for i in np.flatnonzero(unsafe):
            out[i] = self._by_safe_cuts(texts[int(i)].as_py())
        return out


@functools.cache
def _counter(vocab_path: str) -> PartCounter:
    return PartCounter(vocab_path)


def count_tokens(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        counter = _counter(vocab_path)
        for whole in batches:
            for batch in byte_slices(whole, "t"):
                texts = batch.column("t")
                with no_cycle_collection():
                    n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, schema)
