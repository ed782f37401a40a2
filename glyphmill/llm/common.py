"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step handles at a time, whatever Spark's batch size.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of our own only in local mode, where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = sc.getConf().get("spark.checkpoint.dir", None)
    if target is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        target = tempfile.mkdtemp(prefix="glyphmill-ckpt-")
    sc.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more.

    It does so once the driver's JVM has collected its garbage, which may be long
    after; call this between steps, when the frames before a cut are out of scope.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def is_held_out(key: str | Column, modulus: int, remainder: int) -> Column:
    return fold(key, modulus) == F.lit(remainder)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about ``limit`` bytes of text.

    A row is never cut, so a slice of one very long text may exceed the limit.
    """
    if batch.num_rows == 0:
        return
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def parallel_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def no_cycle_collection():
    """Hold back the cycle collector while many small objects without cycles are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def bounded_texts(docs: DataFrame, key: str, text: str, by: str | None, n: int, size: int, labels: DataFrame | None = None, seed: int = 11, most: int = 500):
    """A sample of whole texts ``t`` of each value ``y``, as a pandas frame in hash order of the key.

    For each value, keys are taken by their hash until there are ``n`` texts or the
    texts taken hold ``size`` bytes, whatever the length of each; so a sample exceeds
    ``size`` by less than its last text, and a value with rows is never left out.
    ``y`` is the column ``by`` of ``docs``, or comes from ``labels`` (key, y).  Of more
    than ``most`` values the most frequent are learned from, ties by value, so a column
    of many stray values sends no more than that to the driver.

    Three passes: a count of each value, the hashes and lengths of about ``n`` keys,
    then the texts below the hash where each value's sample ends.  No task and no node
    sorts or gathers more than the sample, and no other text is moved.
    """

    def point(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), point(key).alias("p"), *([F.col(by).alias("y")] if labels is None else [])).where(F.col("t").isNotNull())

    def rows(value: Column, ends: dict | None = None) -> DataFrame:
        """Texts (or their lengths) with their ``y``, up to the hash where each value ends."""

        def below(found: DataFrame) -> DataFrame:
            end = F.element_at(F.create_map(*[F.lit(x) for v, e in sorted(ends.items()) for x in (v, e)]), F.col("y"))
            return found.where(F.col("y").isNotNull() & (F.col("p") <= end))

        found = known.withColumn("t", value)
        if labels is None:
            return found.where(F.col("y").isNotNull()) if ends is None else below(found)
        own = labels.select(F.col(key).alias("k"), "y").where(F.col("y").isNotNull())
        if ends is None:
            return found.join(own, "k")
        # About n keys of each value go to every task, so that no text is moved for the join.
        return found.join(F.broadcast(below(own.withColumn("p", point("k"))).drop("p")), "k")

    def cut(found, lengths: str):
        # The filter's size varies a little: cut to n by the same order, and fix the order.
        found = found.sort_values(["p", "k", lengths], kind="stable")
        before = found.groupby("y")[lengths].cumsum() - found[lengths]
        return found[(found.groupby("y").cumcount() < n) & (before < size)]

    sizes = F.octet_length("t").cast("long")
    counts = {r[0]: r[1] for r in rows(sizes).groupBy("y").count().orderBy(F.desc("count"), "y").limit(most).collect()}
    if not counts:
        return rows(F.col("t")).limit(0).toPandas()
    shares = {v: min(1.0, n / c) for v, c in counts.items()}
    found = rows(sizes, shares).toPandas()
    last = cut(found, "t").groupby("y")["p"].max()
    ends = {v: float(last[v]) for v in counts if v in last.index}
    if not ends:
        return rows(F.col("t")).limit(0).toPandas()
    texts = rows(F.col("t"), ends).toPandas()
    texts["bytes"] = [len(t.encode()) for t in texts["t"]]
    return cut(texts, "bytes")[["t", "y"]].reset_index(drop=True)
