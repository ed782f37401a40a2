"""Sets of documents: what a filter keeps, combined by set operations.

A set is a frame of distinct keys, so it stays distributed at any size; ``persist`` keeps
it for several searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class DocSet:
    def __init__(self, ids: DataFrame, key: str):
        """``ids`` has one column, ``key``, without duplicates."""
        self.ids, self.key = ids.select(key), key

    def persist(self) -> DocSet:
        self.ids = self.ids.persist()
        return self

    def unpersist(self) -> None:
        self.ids.unpersist()

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is in the set."""
        return rows.join(self.ids, self.key, "left_semi")

    def __and__(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.join(other.ids, self.key, "left_semi"), self.key)

    def __or__(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.unionByName(other.ids).distinct(), self.key)

    def __sub__(self, other: DocSet) -> DocSet:
        return DocSet(self.ids.join(other.ids, self.key, "left_anti"), self.key)

    def __xor__(self, other: DocSet) -> DocSet:
        both = self.ids.unionByName(other.ids).groupBy(self.key).count()
        return DocSet(both.where("count = 1"), self.key)

    def flipped(self, universe: DocSet) -> DocSet:
        return universe - self

    def count(self) -> int:
        return self.ids.count()

    def next_from(self, key: int):
        """The smallest key in the set that is not below ``key``; None if there is none."""
        row = self.ids.where(self.ids[self.key] >= key).agg({self.key: "min"}).first()
        return row[0]
