"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and as an RE2 class.
SPACE = r"[\x20\x09-\x0D]"

#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: an expression named inside a lambda would otherwise be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="kinloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def ship(spark: SparkSession) -> None:
    """Lets Spark send this package to every Python worker, once for each context, and keeps Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_kinloom_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="kinloom-"), f"{top.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(at)
    sc._kinloom_sent = True


def give_back() -> None:
    """Hands memory that the allocators of this process hold free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: The tokenizer of a Python worker, by its class and file: one at a time.
_MODEL: dict[tuple[type, str], object] = {}


def model(kind: type, path: str):
    """kind(path), kept by this worker over its tasks until a task asks for another or needs none."""
    if (kind, path) not in _MODEL:
        _MODEL.clear()
        _MODEL[kind, path] = kind(path)
    return _MODEL[kind, path]


def drop_model() -> None:
    _MODEL.clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own_model: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, leaving its worker small: one stage after another uses the same workers, so a tokenizer goes unless `run` has one itself, and freed memory goes back when a task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own_model:
            drop_model()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def release(spark: SparkSession) -> None:
    """A collection on the driver: Spark's cleaner then deletes what was shuffled and broadcast for tables that are written, and the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with their lineage cut; what was shuffled on the way is not needed any more."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


#: Share of the driver's heap in use from which a table on a shelf is followed by a collection.
HEAP_SHARE = 1 / 3
#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shelf:
    """Intermediate tables of one call, as Parquet in the shared folder: only the columns that are read come back, and small files share a task.

    What was shuffled for a table is deleted once it is written, not when the driver's heap happens to be collected.
    Between two tables the driver's heap is collected if much of it is in use: with many partitions and many tables it would grow to its limit otherwise.
    `close` deletes them all; what is returned to a caller must be cut from them before. Large tables that few steps read have a shelf of their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.count = spark, f"{shared_dir(spark)}/kinloom-{uuid.uuid4().hex}", 0

    def put(self, *parts: DataFrame) -> DataFrame:
        """The rows of the parts, which are worked out one after another."""
        self.count += 1
        at = f"{self.top}/{self.count}"
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            for df in parts:
                df.write.mode("append").parquet(at)
        finally:
            self.spark.conf.unset(SHUFFLES_GO) if before is None else self.spark.conf.set(SHUFFLES_GO, before)
        heap = self.spark.sparkContext._jvm.Runtime.getRuntime()
        if heap.totalMemory() - heap.freeMemory() >= HEAP_SHARE * heap.maxMemory():
            release(self.spark)
        return self.spark.read.schema(parts[0].schema).parquet(at)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *what) -> None:
        self.close()


#: Bytes up to which a side is broadcast, by its counted rows; beyond that the join shuffles.
BROADCAST_BYTES = 8 << 20


def small(side: DataFrame, row_bytes: int) -> DataFrame:
    """The side, marked to be broadcast if its rows, counted, fit into BROADCAST_BYTES at `row_bytes` each."""
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


#: Bits of a filter for each key, about, and at most: as many as BROADCAST_BYTES hold.
KEY_BITS, FILTER_BITS = 128, 1 << 26


def perhaps(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows with `_perhaps`, false only where `key` is in no row of `side`: a bit is set for the hash of each key of the side, and the bits are broadcast, so rows aren't shuffled however large the side is."""
    bits = min(FILTER_BITS, 1 << max(15, (KEY_BITS * side.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bit_position(slot)
    maps = side.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "_bucket", "left")
    return told.withColumn("_perhaps", F.coalesce(F.getbit(byte, at.cast("int").bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("_bucket", "_bits")


def among(rows: DataFrame, side: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """The rows whose `key` is in `side`, and some others if the side is too large to be broadcast; rows aren't shuffled."""
    if side.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key, "left_semi")
    return perhaps(rows, side, key).where("_perhaps").drop("_perhaps")


def looked_up(rows: DataFrame, side: DataFrame, key: str, row_bytes: int, how: str = "left") -> DataFrame:
    """rows LEFT (or LEFT ANTI) JOIN side on `key`; if the side is too large to be broadcast, only rows whose key may be in it are shuffled."""
    if side.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key, how)
    told = perhaps(rows, side, key)
    joined = told.where("_perhaps").drop("_perhaps").join(side, key, how)
    return joined.unionByName(told.where("NOT _perhaps").drop("_perhaps"), allowMissingColumns=True)


def draw(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, those with the smallest hashes of `key`, fewer only if the table has fewer.

    Rows are counted first, so that each one tells by itself whether it can be among them: what is sorted, and what
    any number of tasks hands on, is about 2 n rows.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, (2 * n + 100) / max(df.count(), 1))
    return df.where(h < int(share * (1 << 40))).orderBy(h, key).limit(n)


def words_of(text: Column) -> Column:
    """The non-empty words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def carried(docs: DataFrame, doc_id: str, text: str, made: tuple[str, ...], carry: bool) -> tuple[DataFrame, str, list[str], str]:
    """(rows for Python, schema of what is handed through, its names, name of the text): the id as doc_id, or every column of docs but those called like the ones made.

    A text that is handed through anyway is sent once.
    """
    fields = [f for f in docs.schema.fields if f.name not in (*made, "_text")] if carry else []
    own = next((f.name for f in fields if f.name == text and f.dataType.simpleString() == "string"), None)
    kept = [F.col(f.name) for f in fields] or [F.col(doc_id).alias("doc_id")]
    rows = docs.select(*kept) if own else docs.select(*kept, F.col(text).cast("string").alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), [f.name for f in fields], own or "_text"


def rows_of(batch, kept: list[str], low: int, high: int) -> list:
    """The columns handed through, of some rows of a batch."""
    return [batch.column(c).slice(low, high - low) for c in kept]
