"""Batch-wise word handling: Arrow splits texts and numbers the distinct words,
so Python code touches each distinct word of a batch once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Numbered:
    """Words of a batch of texts: ``codes[offsets[i]:offsets[i + 1]]`` index ``words`` for text i."""

    offsets: np.ndarray
    codes: np.ndarray
    words: list


def number(lists: pa.ListArray) -> Numbered:
    """Number the distinct values of a list array without nulls."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return Numbered(offsets - offsets[0], encoded.indices.to_numpy(zero_copy_only=False), words)


def without(n: Numbered, drop: np.ndarray) -> Numbered:
    """Leave out the words whose flag in ``drop`` (one per distinct word) is set."""
    keep = ~drop[n.codes] if len(n.codes) else np.zeros(0, bool)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return Numbered(kept_before[n.offsets], n.codes[keep], n.words)


def ascii_words(texts: pa.Array) -> Numbered:
    r"""Words ``[^\x20\x09-\x0D]+`` of texts without nulls, empty ones dropped."""
    n = number(pc.ascii_split_whitespace(texts))
    return without(n, np.fromiter((not w for w in n.words), bool, len(n.words)))


def space_parts(texts: pa.Array, newline: str) -> Numbered:
    """Parts between single spaces, each newline first replaced by ``newline``; may be empty."""
    return number(pc.split_pattern(pc.replace_substring(texts, "\n", newline), " "))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s : s + n]`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return values[index]
