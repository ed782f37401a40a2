"""Scoring functions: as plain numbers for the driver and as columns for Spark."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the norm format: the exponent of byte zero and the kept mantissa bits.
_NORM_BIAS, _NORM_SHIFT = 48, 21


def encode_norm(f: float) -> int:
    """A non-negative float as one byte: the top bits of its single-precision form."""
    if not f > 0:
        return 0
    bits = struct.unpack("<I", struct.pack("<f", f))[0] >> _NORM_SHIFT
    return min(max(bits - (_NORM_BIAS << 3), 0), 255)


def decode_norm(byte: int) -> float:
    byte &= 0xFF
    return struct.unpack("<f", struct.pack("<I", (byte + (_NORM_BIAS << 3)) << _NORM_SHIFT))[0] if byte else 0.0


def norm_column(f: Column) -> Column:
    """``decode_norm(encode_norm(f))`` as a column: f cut to three significant bits.

    The power of two is found by logarithm and put right where rounding moved it.
    """
    x = f.cast("float").cast("double")
    e = F.floor(F.log2(x)).cast("double")
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    unit = F.pow(F.lit(2.0), e - 2)
    return F.when(x > 0, F.floor(x / unit) * unit).otherwise(F.lit(0.0))


class Similarity:
    """TF-IDF with length normalisation; subclass and override to change a part."""

    def idf(self, doc_freq: int, total_docs: int) -> float:
        return 1.0 if total_docs == 0 else 1.0 + math.log(total_docs / (1 + doc_freq))

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq.cast("double"))

    def length_norm(self, n_tokens: Column) -> Column:
        return F.when(n_tokens > 0, 1.0 / F.sqrt(n_tokens.cast("double"))).otherwise(F.lit(0.0))

    def query_norm(self, sum_of_squares: float) -> float:
        return 1.0 / math.sqrt(sum_of_squares) if sum_of_squares else 0.0

    def coord(self, overlap: Column | int, most: int) -> Column | float:
        """Factor for matching ``overlap`` of ``most`` clauses; queries pass a column."""
        return overlap / most if most else 1.0

    def field_norm(self, n_tokens: Column, boost: Column) -> Column:
        return norm_column(boost * self.length_norm(n_tokens))


class LongFieldSimilarity(Similarity):
    """For long fields: texts under a hundred tokens get no further bonus."""

    def length_norm(self, n_tokens: Column) -> Column:
        return F.when(n_tokens > 0, 1.0 / F.sqrt(F.greatest(n_tokens, F.lit(100)).cast("double"))).otherwise(F.lit(0.0))


SIMILARITIES = {"default": Similarity, "long_field": LongFieldSimilarity}


def register_similarity(name: str, kind: type[Similarity]) -> None:
    """Let field types name a similarity; readers of a stored index need it too."""
    SIMILARITIES[name] = kind
