"""A small front for common use: one analyzed type for all text, add and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions.analysis import PolyAnalyzer
from glyphmill.operators.search import Searcher
from glyphmill.plans.schema import Schema, full_text
from glyphmill.sources.index import Indexer, IndexReader


class Simple:
    def __init__(self, spark: SparkSession, path: str, language: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key
        self._type = lambda: full_text(PolyAnalyzer(language), highlightable=True)
        self._searcher: Searcher | None = None

    def add(self, docs: DataFrame) -> None:
        """Add documents; every column besides the key is a text field."""
        schema = Schema()
        for name in docs.columns:
            if name != self.key:
                schema.spec_field(name, self._type())
        with Indexer(self.spark, self.path, schema, self.key) as writer:
            writer.add(docs)
            writer.commit()
        self._searcher = None

    def search(self, query: str, num_wanted: int = 10, offset: int = 0) -> DataFrame:
        return self._open().hits(query, num_wanted, offset)

    def total_hits(self, query: str) -> int:
        return self._open().total_hits(query)

    def _open(self) -> Searcher:
        if self._searcher is None:
            self._searcher = Searcher(IndexReader(self.spark, self.path))
        return self._searcher
