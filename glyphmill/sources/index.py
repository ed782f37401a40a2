"""A stored inverted index: immutable segments of Parquet under JSON manifests.

    manifest-N.json                names the segments and deletions of generation N
    docs/seg=S                     stored fields and key
    postings/seg=S/field=F         (term, key, tf, norm, positions), clustered by term
    lexicon/seg=S                  (field, term, doc_freq)
    extra-C/seg=S                  rows of a further component C
    del-N                          (key, before): keys deleted from older segments

A commit writes data first and then renames a manifest into place, so readers see
all of it or nothing and keep their generation while later ones appear.

A segment's name starts with its order.  A deletion holds for segments of a lower
order than its ``before`` only, so a key can be deleted and added again.  All
segments of a part are one read with ``seg`` as a partition column.

Postings are made document by document and move once, to the partition of their
term's hash; terms that a sample shows to be frequent are dealt over several
partitions by the key.  So a text is tokenized once and a lookup reads few files.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import json
import math
import operator
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.plans.compiler import Needs, Statistics
from glyphmill.plans.query import Query
from glyphmill.plans.schema import KINDS, Schema
from glyphmill.sources.reader import computed_once, gathered, matches, wanted_rows


class Folder:
    """Small files of an index, in any store that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        if not self._fs.exists(self._at(below)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(below)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        self._fs.mkdirs(self._at(""))
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001  the store's own exception type
            if "exist" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        return not self._fs.exists(self._at(new)) and self._fs.rename(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class LockError(RuntimeError):
    pass


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Lock:
    """One holder at a time, by a file that only one can create.

    The file names its holder.  A lock is stale, and cleared by whoever wants it next,
    if its process on this host is gone, or if it is older than ``max_age`` seconds.
    """

    def __init__(self, folder: Folder, name: str, timeout: float = 1.0, max_age: float | None = None):
        self.folder, self.file, self.timeout, self.max_age = folder, f"{name}.lock", timeout, max_age
        self.held = False

    def holder(self) -> dict | None:
        """Who holds the lock: host, process and time; None if nobody does."""
        try:
            return json.loads(self.folder.read(self.file))
        except Exception:  # noqa: BLE001  gone, or not yet written
            return None

    def is_stale(self) -> bool:
        who = self.holder()
        if who is None:
            return False
        if who["host"] == socket.gethostname() and not _alive(who["pid"]):
            return True
        return self.max_age is not None and time.time() - who["since"] > self.max_age

    def obtain(self) -> Lock:
        until = time.monotonic() + self.timeout
        while not self.folder.create(self.file, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.time()})):
            if self.is_stale():
                self.folder.delete(self.file)
                continue
            if time.monotonic() >= until:
                raise LockError(f"{self.file} is held by {self.holder()}")
            time.sleep(0.1)
        self.held = True
        return self

    def release(self) -> None:
        if self.held:
            self.folder.delete(self.file)
            self.held = False

    def __enter__(self) -> Lock:
        return self if self.held else self.obtain()

    def __exit__(self, *_) -> None:
        self.release()


def order_of(segment: str) -> int:
    return int(segment[:10])


@dataclass
class Manifest:
    generation: int
    schema: Schema
    key: str
    key_type: str
    segments: dict[str, int]  # name → documents, deleted ones included
    deletions: dict[str, int]  # name → the order that its segments are below
    clock: int = 0  # the next segment's order
    extras: dict[str, str] = field(default_factory=dict)  # component → its columns

    def dumps(self) -> str:
        return json.dumps(self.__dict__ | {"schema": json.loads(self.schema.dumps())}, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Manifest:
        data = json.loads(text)
        return cls(**(data | {"schema": Schema.loads(json.dumps(data["schema"]))}))


def latest(folder: Folder, attempts: int = 3) -> Manifest | None:
    """The newest manifest; looked for again if a purge takes it away meanwhile."""
    for attempt in range(attempts):
        found = [n for n in folder.names() if n.startswith("manifest-") and n.endswith(".json")]
        if not found:
            return None
        try:
            return Manifest.loads(folder.read(found[-1]))
        except Exception:  # noqa: BLE001  the store's own exception type
            if attempt == attempts - 1:
                raise
    return None


#: Tokens that the inversion handles at once; a text of more is handled by itself.
SLICE_TOKENS = 1 << 18


def token_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rows of at most ``limit`` tokens, or of one row; ``offsets`` are those of a list array."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1, start + 1)
        yield start, stop
        start = stop


def invert(docs: DataFrame, schema: Schema, key: str, boost: str | None = None) -> DataFrame:
    """Postings (field, term, key, tf, norm, positions) of every indexed field of ``docs``.

    Python handles ``SLICE_TOKENS`` at a time, whatever the number and length of the texts in a batch,
    and sends each slice on in the order of its terms: the sort of a segment merges such runs.
    """
    key_type = docs.schema[key].dataType
    out_schema = T.StructType([T.StructField("term", T.StringType()), T.StructField(key, key_type), T.StructField("tf", T.IntegerType()), T.StructField("norm", T.DoubleType()), T.StructField("mean_boost", T.DoubleType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in out_schema]

    def run(batches):
        for batch in batches:
            for start, stop in token_slices(batch.column("terms").offsets.to_numpy(), SLICE_TOKENS):
                yield postings(batch.slice(start, stop - start))

    def postings(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("terms")
        offsets = lists.offsets.to_numpy()
        lengths = np.diff(offsets)
        encoded = lists.flatten().dictionary_encode()
        # By term; a stable sort keeps documents, and positions in each, in order.
        alphabetic = pc.array_sort_indices(encoded.dictionary)
        rank = np.empty(len(alphabetic), np.uint16 if len(alphabetic) <= 1 << 16 else np.int64)  # numpy sorts 16 bits by radix
        rank[alphabetic.to_numpy()] = np.arange(len(alphabetic))
        rank = rank[encoded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(rank, kind="stable")
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        position = (np.arange(len(owner)) - (offsets[:-1] - offsets[0])[owner]).astype(np.int32)
        rank, owner = rank[order], owner[order]
        first = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (owner[1:] != owner[:-1]))) if len(rank) else np.zeros(0, np.int64)
        ends = np.append(first, len(rank)).astype(np.int32)
        rows, tf = pa.array(owner[first]), np.diff(ends)
        boosts = batch.column("boosts").flatten().to_numpy(zero_copy_only=False)
        # Field by field all rows have boosts or none has.
        means = pa.array(np.add.reduceat(boosts[order], first) / tf) if len(boosts) else pa.nulls(len(first), pa.float64())
        terms = encoded.dictionary.take(alphabetic.take(pa.array(rank[first])))
        return pa.RecordBatch.from_arrays([terms, batch.column(key).take(rows), pa.array(tf), batch.column("norm").take(rows), means, pa.ListArray.from_arrays(pa.array(ends), pa.array(position[order]))], names=names)

    parts = []
    for name in schema.searchable():
        kind = schema.fields[name]
        doc_boost = (F.col(boost) if boost else F.lit(1.0)).cast("double") * F.lit(kind.boost)
        rows = docs.where(F.col(name).isNotNull())
        if kind.kind != "text" and kind.posting != "rich":
            # A value is its one term.
            found = rows.select(F.element_at(kind.terms(F.col(name)), 1).alias("term"), key, F.lit(1).alias("tf"), kind.sim().field_norm(F.lit(1), doc_boost).alias("norm"), F.array(F.lit(0)).alias("positions"))
        else:
            boosts = kind.analyzer.boosts(F.col(name)) if kind.posting == "rich" else F.lit(None)
            rows = computed_once(rows.select(key, kind.terms(F.col(name)).alias("terms"), doc_boost.alias("doc_boost"), boosts.cast("array<double>").alias("boosts")))
            rows = rows.select(key, "terms", kind.sim().field_norm(F.size("terms"), F.col("doc_boost")).alias("norm"), "boosts")
            found = rows.mapInArrow(run, out_schema).withColumn("norm", F.coalesce(F.col("mean_boost") * F.lit(kind.boost), F.col("norm")))
        parts.append(found.select(F.lit(name).alias("field"), "term", key, "tf", "norm", "positions"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"field string, term string, {key} {key_type.simpleString()}, tf int, norm double, positions array<int>")


class IndexReader:
    """One generation of an index, as a source of rows for queries."""

    def __init__(self, spark: SparkSession, path: str, generation: int | None = None):
        found = latest(Folder(spark, path)) if generation is None else Manifest.loads(Folder(spark, path).read(f"manifest-{generation:010d}.json"))
        if found is None:
            raise FileNotFoundError(f"no index at {path}")
        self._open(spark, path, found)

    def _open(self, spark: SparkSession, path: str, manifest: Manifest) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.manifest, self.schema, self.key = manifest, manifest.schema, manifest.key

    @classmethod
    def over(cls, spark: SparkSession, path: str, manifest: Manifest) -> IndexReader:
        """A reader of a state that has no manifest file (yet)."""
        reader = object.__new__(cls)
        reader._open(spark, path, manifest)
        return reader

    def pin(self) -> Lock:
        """A shared lock: while it is held, ``purge`` keeps this generation."""
        return Lock(self.folder, f"pin-{self.manifest.generation:010d}-{uuid.uuid4().hex}")

    def _ddl(self, part: str) -> str:
        key = f"`{self.key}` {self.manifest.key_type}"
        if part == "docs":
            return ", ".join([key, *(f"`{n}` {KINDS[t.kind]}" for n, t in self.schema.fields.items() if n != self.key and (t.stored or t.sortable))])
        if part == "postings":
            return f"term string, {key}, tf int, norm double, positions array<int>, field string"
        if part == "lexicon":
            return "field string, term string, doc_freq bigint"
        return self.manifest.extras[part.removeprefix("extra-")]

    def _all(self, part: str) -> DataFrame:
        """A part of all segments in one read; fields that a segment lacks are null."""
        ddl = self._ddl(part) + ", seg string"
        paths = [f"{self.path}/{part}/seg={s}" for s in self.manifest.segments if self.folder.exists(f"{part}/seg={s}")]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.path}/{part}").parquet(*paths)

    def deleted(self) -> DataFrame | None:
        """(key, before): keys deleted from segments of an order below ``before``."""
        oldest = min(map(order_of, self.manifest.segments), default=0)
        paths = [f"{self.path}/{d}" for d, before in self.manifest.deletions.items() if before > oldest]
        return self.spark.read.schema(f"`{self.key}` {self.manifest.key_type}, before int").parquet(*paths) if paths else None

    def _live(self, rows: DataFrame, how: str = "left_anti") -> DataFrame:
        """Rows of documents that no deletion names, without ``seg``; small deletions are sent around."""
        gone = self.deleted()
        if gone is None:
            return rows.drop("seg") if how == "left_anti" else rows.limit(0).drop("seg")
        gone = gone.select(F.col(self.key).alias(".gone"), "before")
        hit = (F.col(self.key) == F.col("`.gone`")) & (F.substring("seg", 1, 10).cast("int") < F.col("before"))
        return rows.join(gone, hit, how).drop("seg")

    def stored(self) -> DataFrame:
        return self._live(self._all("docs"))

    def component(self, name: str) -> DataFrame:
        """Rows that the writer ``name`` made of the live documents."""
        return self._live(self._all(f"extra-{name}"))

    def postings(self) -> DataFrame:
        """Postings with their segment, those of deleted documents included."""
        return self._all("postings")

    def posting_list(self, field: str, term: str) -> DataFrame:
        """Documents of a term: the file reader prunes by field and term."""
        return self._live(self.postings().where((F.col("field") == field) & (F.col("term") == term)))

    def lexicon(self, field: str | None = None, seek: str | None = None) -> DataFrame:
        """(field, term, doc_freq) over all segments, deleted documents included; from ``seek`` on."""
        found = self._all("lexicon")
        if field is not None:
            found = found.where(F.col("field") == field)
        if seek is not None:
            found = found.where(F.col("term") >= seek)
        return found.groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"))

    def doc_freq(self, field: str, term: str) -> int:
        row = self.lexicon(field).where(F.col("term") == term).first()
        return row["doc_freq"] if row else 0

    def doc_max(self) -> int:
        return sum(self.manifest.segments.values())

    def del_count(self) -> int:
        return self._live(self._all("docs").select(self.key, "seg"), "left_semi").count()

    def doc_count(self) -> int:
        return self.doc_max() - self.del_count()

    def fetch_doc(self, doc_id: int):
        return self.stored().where(F.col(self.key) == doc_id).first()

    def sort_column(self, field: str) -> DataFrame:
        """(key, value) of a sortable field."""
        if not self.schema.type_of(field).sortable:
            raise ValueError(f"field {field!r} is not sortable")
        return self.stored().select(self.key, field)

    def unique_values(self, field: str) -> DataFrame:
        """Distinct values of a sortable field in its order, with their numbers of documents."""
        order = self.schema.type_of(field).sort_key(F.col(field)).asc_nulls_last()
        return self.sort_column(field).groupBy(field).agg(F.count("*").alias("n_docs")).orderBy(order)

    # What queries read.

    def statistics(self, need: Needs) -> Statistics:
        terms = need.term_list()
        found: dict[tuple[str, str], int] = {}
        if terms and self.manifest.segments:
            wanted = functools.reduce(operator.or_, ((F.col("field") == f) & F.col("term").isin([t for g, t in terms if g == f]) for f in need.fields()))
            # As many rows as the query has terms.
            found = {(r["field"], r["term"]): r["doc_freq"] for r in self.lexicon().where(wanted).collect()}
        return Statistics(self.doc_max(), found)

    def rows(self, need: Needs, columns: list[str]) -> DataFrame:
        by_doc = gathered(self._live(self.postings().where(wanted_rows(need))), need, self.key)
        columns = list(dict.fromkeys(c for c in [*need.columns, *columns] if c != self.key))
        if need.all_documents or columns:
            docs = self.stored().select(self.key, *columns)
            return docs.join(by_doc, self.key, "left" if need.all_documents else "inner")
        return by_doc


def fibonacci(n: int) -> int:
    """The n-th Fibonacci number, exact up to n = 70."""
    root = math.sqrt(5.0)
    return round(((1 + root) / 2) ** n / root)


def choose_sparse(doc_counts: list[int]) -> int:
    """How many of the smallest segments to merge; ``doc_counts`` ascend.

    A merge of the k smallest pays while the documents it rewrites number less than a
    Fibonacci number, by how many segments there are beyond those already found worth
    merging.  A lone small segment takes its neighbour along if that is less than
    twice its size.
    """
    segments = len(doc_counts)
    k = 0
    for size, rewritten in enumerate(itertools.accumulate(doc_counts), start=1):
        k = size if rewritten < fibonacci(segments - k + 6) else k
    lone = k == 1 and segments > 2
    return 2 if lone and doc_counts[1] // 2 < doc_counts[0] else k


def _named(name: str, term: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), term.alias("term"))


def sampled_lexicon(docs: DataFrame, schema: Schema, total: int, sample: int = 2_000) -> DataFrame:
    """(field, term, doc_freq) over about ``sample`` of ``total`` documents."""
    some = docs.sample(min(1.0, sample / total), seed=7) if total > sample else docs
    none = F.array().cast("array<struct<field:string,term:string>>")
    entries = [F.coalesce(F.transform(F.array_distinct(schema.fields[n].terms(F.col(n))), functools.partial(_named, n)), none) for n in schema.searchable()]
    return some.select(F.explode(F.concat(none, *entries)).alias("e")).groupBy("e.field", "e.term").agg(F.count("*").alias("doc_freq"))


def frequent(lexicon: DataFrame, partitions: int) -> DataFrame | None:
    """(field, term, shares): into how many partitions to deal the postings of frequent terms.

    A term is frequent if its postings exceed half of a partition's fair share, so there
    are less than twice as many of them as partitions: few enough to send around.
    """
    if partitions <= 1:
        return None
    lexicon = lexicon.persist()
    try:
        total = lexicon.agg(F.sum("doc_freq")).first()[0] or 0
        fair = max(total / partitions, 1.0)
        found = lexicon.where(F.col("doc_freq") > fair / 2).select("field", "term", F.least(F.lit(partitions), F.ceil(2 * F.col("doc_freq") / fair)).cast("int").alias("shares"))
        rows = found.collect()
    finally:
        lexicon.unpersist()
    return lexicon.sparkSession.createDataFrame(rows, "field string, term string, shares int") if rows else None


class Indexer:
    """One session of changes to an index; nothing shows before ``commit``.

    ``writers`` make further components: each gets the documents added and returns rows
    that hold their key; readers get them by ``component``.
    """

    #: Segments with at least this share of deleted documents are merged too.
    DELETED_SHARE = 0.1

    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None, key: str = "doc_id", create: bool = True, truncate: bool = False, partitions: int | None = None, recycle=None, timeout: float = 1.0, codec: str | None = None, writers: dict | None = None):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.lock = Lock(self.folder, "write", timeout).obtain()
        try:
            known = latest(self.folder)
            if known is None and (not create or schema is None):
                raise FileNotFoundError(f"no index at {path}")
            self.base = known
            fresh = truncate or known is None
            grown = (schema or known.schema) if fresh else known.schema.merged(schema or Schema())
            generation = (known.generation if known else 0) + 1
            self.state = Manifest(generation, grown, key if fresh else known.key, "bigint" if fresh else known.key_type, {} if fresh else dict(known.segments), {} if fresh else dict(known.deletions), known.clock if known else 0, {} if fresh else dict(known.extras))
        except BaseException:
            self.lock.release()
            raise
        self.partitions, self.codec, self.writers = partitions, codec, writers or {}
        self.recycle = recycle or self.choose_segments
        self._new = 0

    schema = property(lambda self: self.state.schema)
    key = property(lambda self: self.state.key)
    segments = property(lambda self: self.state.segments)
    generation = property(lambda self: self.state.generation)

    def __enter__(self) -> Indexer:
        return self

    def __exit__(self, kind, *_) -> None:
        self.lock.release()

    def _suffix(self) -> str:
        self._new += 1
        return f"g{self.generation:010d}-{self._new:04d}"

    def _write(self, frame: DataFrame, part: str, segment: str) -> None:
        out = frame.write.mode("overwrite")
        if self.codec:
            out = out.option("compression", self.codec)
        out.parquet(f"{self.path}/{part}/seg={segment}")

    def _partitions(self) -> int:
        return self.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write_segment(self, docs: DataFrame, postings: DataFrame, segment: str, lexicon: DataFrame, extras: dict[str, DataFrame] | None = None) -> None:
        """Write a segment's parts; ``segments`` gets it once all are there.

        ``lexicon`` tells, exactly or from a sample, which terms are frequent.
        """
        self._write(docs, "docs", segment)
        hot = frequent(lexicon, self._partitions())
        by: list = ["term"]
        if hot is not None:
            postings = postings.join(F.broadcast(hot), ["field", "term"], "left")
            by.append(F.coalesce(F.pmod(F.xxhash64(self.key), F.col("shares")), F.lit(0)))
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for name in self.schema.searchable():
            # Each field by itself: a sort that begins with the term compares its first bytes alone, as a rule.
            clustered = postings.where(F.col("field") == name).drop("field").repartition(self._partitions(), *by).drop("shares").sortWithinPartitions("term", self.key)
            self._write(clustered, "postings", f"{segment}/field={escaped(name)}")
        for name, frame in (extras or {}).items():
            self._write(frame, f"extra-{name}", segment)
        mine = self._view({segment: 0}, {})
        counts = mine.postings().groupBy("field", "term").agg(F.count("*").alias("doc_freq"))
        self._write(counts.sortWithinPartitions("field", "term"), "lexicon", segment)
        self.segments[segment] = mine._all("docs").count()

    def add(self, docs: DataFrame, boost: str | None = None, replace: bool = False, tag: str | None = None) -> Indexer:
        """Add documents; every column but the key and the boost must be a field.

        A key names one document: keys that are there already are an error, or with
        ``replace`` their old documents are deleted; a key twice in ``docs``, or null, is an error.
        """
        unknown = [c for c in docs.columns if c not in (self.key, boost) and c not in self.schema.fields]
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        key_type = docs.schema[self.key].dataType.simpleString()
        if not self.segments:
            self.state.key_type = key_type
        wanted = [c for c in docs.columns if c in self.schema.fields and c != self.key]
        typed = docs.select(F.col(self.key).cast(self.state.key_type), *(F.col(c).cast(KINDS[self.schema.fields[c].kind]).alias(c) for c in wanted), *([boost] if boost else []))
        kept = [c for c in wanted if self.schema.fields[c].stored or self.schema.fields[c].sortable]
        own = Schema({n: t for n, t in self.schema.fields.items() if n in wanted})
        typed, total, done = self._spread(typed)
        extras = {name: make(typed) for name, make in self.writers.items()}
        self.state.extras |= {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) for name, frame in extras.items()}
        before = self._reader()
        segment = f"{self.state.clock:010d}-{tag or self._suffix()}"
        lexicon = sampled_lexicon(typed, own, total)
        try:
            self._write_segment(typed.select(self.key, *kept), invert(typed, own, self.key, boost), segment, lexicon, extras)
            new = self._view({segment: 0}, {})._all("docs").select(self.key)
            if new.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).head(1):
                raise ValueError("a key is null or names two of the documents")
            if before.manifest.segments:
                known = before.stored().select(self.key).join(new, self.key, "left_semi")
                if replace:
                    self._delete(known, self.state.clock)
                elif known.head(1):
                    raise ValueError("a key names a document that is there already")
        except BaseException:
            self.segments.pop(segment, None)
            raise
        finally:
            done()
        self.state.clock += 1
        return self

    def _spread(self, docs: DataFrame) -> tuple[DataFrame, int, Callable[[], object]]:
        """(documents, their number, what to call after use).

        Rows of an input that occupies few partitions, such as a file of one row group,
        are dealt over all cores and kept for the passes over them; others stay in place.
        """
        cores = self.spark.sparkContext.defaultParallelism
        total, occupied = docs.select(F.spark_partition_id().alias("p")).agg(F.count("*"), F.count_distinct("p")).first()
        if not total or occupied >= cores:
            return docs, total, lambda: None
        kept = docs.repartition(cores).persist()
        return kept, total, kept.unpersist

    def _view(self, segments: dict[str, int], deletions: dict[str, int]) -> IndexReader:
        return IndexReader.over(self.spark, self.path, dataclasses.replace(self.state, segments=segments, deletions=deletions))

    def _reader(self) -> IndexReader:
        """This session's state, uncommitted changes included."""
        return self._view(dict(self.segments), dict(self.state.deletions))

    def add_index(self, other: IndexReader, shift: int = 0) -> Indexer:
        """Add the live documents of another index, their keys shifted; keys must be new."""
        self.state.schema = self.schema.merged(other.schema)
        if not self.segments:
            self.state.key_type = other.manifest.key_type
        moved = (F.col(other.key) + F.lit(shift)).cast(self.state.key_type).alias(self.key)
        move = lambda df: df.select(*(moved if c == other.key else F.col(f"`{c}`") for c in df.columns))
        known = self._reader().stored().select(self.key).join(move(other.stored().select(other.key)), self.key, "left_semi")
        if self.segments and known.head(1):
            raise ValueError("a key names a document that is there already")
        self._write_segment(move(other.stored()), move(other._live(other.postings())), f"{self.state.clock:010d}-{self._suffix()}", other.lexicon())
        self.state.clock += 1
        return self

    def _delete(self, keys: DataFrame, before: int | None = None) -> Indexer:
        """Delete keys from the segments there are now."""
        name = f"del-{self._suffix()}"
        order = self.state.clock if before is None else before
        keys.select(self.key).distinct().withColumn("before", F.lit(order)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.state.deletions[name] = order
        return self

    def delete_by_term(self, field: str, term: str) -> Indexer:
        """Analyzed fields go by the first token of the text."""
        kind = self.schema.type_of(field)
        if kind.kind == "text":
            tokens = kind.analyzer.split(term)
            if not tokens:
                return self
            term = tokens[0]
        return self._delete(self._reader().posting_list(field, term))

    def delete_by_query(self, query: Query) -> Indexer:
        return self._delete(matches(self._reader(), query, need_score=False))

    def delete_by_doc_id(self, doc_id: int) -> Indexer:
        return self._delete(self._reader().stored().where(F.col(self.key) == doc_id))

    def _live_counts(self) -> dict[str, int]:
        reader = self._reader()
        docs = reader._all("docs").select(self.key, "seg", F.col("seg").alias(".own"))
        found = {r[".own"]: r["count"] for r in reader._live(docs).groupBy("`.own`").count().collect()}  # a row a segment
        return {s: found.get(s, 0) for s in self.segments}

    def choose_segments(self, live: dict[str, int]) -> list[str]:
        by_size = sorted(live, key=lambda s: (live[s], s))
        n = choose_sparse([live[s] for s in by_size])
        worn = [s for s in by_size[n:] if self.segments[s] and 1 - live[s] / self.segments[s] >= self.DELETED_SHARE]
        return by_size[:n] + worn

    def _merge(self, chosen: dict[str, int], deletions: dict[str, int], suffix: str) -> None:
        """Write the live rows of ``chosen`` as one segment, of the highest order among them."""
        part = self._view(chosen, deletions)
        extras = {name: part.component(name) for name in self.state.extras}
        self._write_segment(part.stored(), part._live(part.postings()), f"{max(map(order_of, chosen)):010d}-{suffix}", part.lexicon(), extras)

    def optimize(self, everything: bool = True) -> Indexer:
        """Merge segments into one without deleted documents: all, or those worth it."""
        chosen = list(self.segments) if everything else self.recycle(self._live_counts())
        if not chosen or (len(chosen) == 1 and not self.state.deletions):
            return self
        others = set(self.segments) - set(chosen)
        self._merge({s: self.segments[s] for s in chosen}, dict(self.state.deletions), self._suffix())
        for s in chosen:
            del self.segments[s]
        if not others:
            self.state.deletions.clear()  # no old document is left that they could name
        return self

    def prepare_commit(self) -> str:
        """Write the manifest under a draft name; ``commit`` makes it count."""
        draft = f".draft-manifest-{self.generation:010d}.json"
        self.folder.delete(draft)
        self.folder.create(draft, self.state.dumps())
        return draft

    def commit(self) -> int:
        draft = self.prepare_commit()
        try:
            if not self.folder.rename(draft, f"manifest-{self.generation:010d}.json"):
                raise RuntimeError(f"generation {self.generation} is there already")
        finally:
            self.lock.release()
        return self.generation


_PARTS = ("docs", "postings", "lexicon")


def purge(spark: SparkSession, path: str, pinned: list[int] = (), timeout: float = 0.0) -> list[str]:
    """Remove what neither the latest manifest nor a pinned generation names.

    Takes the write and merge locks, so no session's unfinished segment can be lost: it
    raises ``LockError`` beside an open writer or merger.  Generations that readers hold
    by ``IndexReader.pin`` stay; pins of processes that are gone are cleared.
    """
    folder = Folder(spark, path)
    with Lock(folder, "write", timeout), Lock(folder, "merge", timeout):
        names = folder.names()
        keep_files = {n for n in names if n.startswith("manifest-")}
        keep_files = {*sorted(keep_files)[-1:], *(f"manifest-{g:010d}.json" for g in pinned)}
        for n in names:
            if n.startswith("pin-") and n.endswith(".lock"):
                if Lock(folder, n.removesuffix(".lock")).is_stale():
                    folder.delete(n)
                else:
                    keep_files.add(f"manifest-{n.split('-')[1]}.json")
        kept = set(keep_files)
        for n in keep_files & set(names):
            m = Manifest.loads(folder.read(n))
            kept |= {*m.segments, *m.deletions}
        gone = [n for n in names if n not in kept and n.startswith(("del-", "manifest-", ".draft-"))]
        for part in names:
            if part in _PARTS or part.startswith("extra-"):
                gone += [f"{part}/{s}" for s in folder.names(part) if s.removeprefix("seg=") not in kept]
        for n in gone:
            folder.delete(n)
    return gone


class BackgroundMerger:
    """Merges the segments of one generation while others write; later deletions still hold.

    The merged segment has the highest order of those it replaces, so deletions made
    meanwhile apply to it and documents added meanwhile are not touched.  The write lock
    is taken only to swap segments.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.lock = Lock(self.folder, "merge", 0.0).obtain()
        try:
            self.seen = IndexReader(spark, path).manifest
        except BaseException:
            self.lock.release()
            raise

    def prepare(self) -> BackgroundMerger:
        helper = object.__new__(Indexer)
        helper.spark, helper.path, helper.folder = self.spark, self.path, self.folder
        helper.partitions, helper.codec, helper.state = None, None, dataclasses.replace(self.seen, segments={})
        try:
            helper._merge(dict(self.seen.segments), dict(self.seen.deletions), f"m{self.seen.generation:010d}")
        except BaseException:
            self.lock.release()
            raise
        self.merged = helper.segments
        return self

    def commit(self, timeout: float = 1.0) -> int:
        try:
            with Indexer(self.spark, self.path, timeout=timeout) as writer:
                writer.state.segments = {s: n for s, n in writer.segments.items() if s not in self.seen.segments} | self.merged
                writer.state.deletions = {d: b for d, b in writer.state.deletions.items() if d not in self.seen.deletions}
                return writer.commit()
        finally:
            self.lock.release()
