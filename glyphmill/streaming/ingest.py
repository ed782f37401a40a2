"""Continuous indexing: each micro-batch of a stream becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphmill.plans.schema import Schema
from glyphmill.sources.index import Indexer, latest


def index_stream(stream: DataFrame, path: str, schema: Schema, checkpoint: str, key: str = "doc_id", merge_every: int = 0, replace: bool = False, **trigger) -> StreamingQuery:
    """Start a query that commits each batch; a batch that is run again is not added twice.

    Segment names carry the batch number, which the manifest keeps: after a failure
    between commit and checkpoint the repeated batch is recognised and left out.  With
    ``replace`` a key that comes again replaces its document.
    """

    def add(batch: DataFrame, number: int) -> None:
        mark = f"batch-{number:012d}"
        newest = lambda s: s[11:] == mark
        with Indexer(batch.sparkSession, path, schema, key, timeout=30.0) as writer:
            if batch.isEmpty() or any(map(newest, writer.segments)):
                return
            writer.add(batch, replace=replace, tag=mark)
            if merge_every and len(writer.segments) >= merge_every:
                # The newest batch stays recognisable.
                writer.recycle = lambda live: [s for s in writer.choose_segments(live) if not newest(s)]
                writer.optimize(everything=False)
            writer.commit()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(folder) -> int:
    found = latest(folder)
    return found.generation if found else 0
