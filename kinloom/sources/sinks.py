"""Writers: published directories, id-list files, reports."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tsv import ingest


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes beside the target and renames when all is there.

    The old table is moved aside first and comes back if the new one can't take its place; a failed write leaves
    the old table and no rest.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    fs, to = _fs(spark, path)
    (_, new), (_, old) = _fs(spark, f"{path}.{name}.tmp"), _fs(spark, f"{path}.{name}.old")
    try:
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(new.toString())
        aside = fs.exists(to)
        if aside and not fs.rename(to, old):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(new, to):
            if aside:
                fs.rename(old, to)
            raise OSError(f"{path} can't be published")
    finally:
        fs.delete(new, True)
        if fs.exists(to):
            fs.delete(old, True)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON file with sorted keys, in any store Spark can write."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=1, default=str).encode()))
    finally:
        out.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files at a path; each is read as one value, so for files that fit one task."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def ingest_to_parquet(spark: SparkSession, path: str, label: str, out: str) -> dict:
    """Ingests a source file; returns its statistics. A file with a header only gives an empty table of the same schema."""
    began = time.time()
    publish_parquet(ingest(spark, path, label), out)
    return {"source_label": label, "row_count": spark.read.parquet(out).count(), "out_path": out, "seconds": round(time.time() - began, 2)}


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """Header, tabs, newline; fields as they are."""
    rows = df.coalesce(1) if one_file else df
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def id_lists(queries: DataFrame, pairs: DataFrame, query: str, target: str, out: str) -> DataFrame:
    """One row for each query with its sorted, comma-joined distinct targets; none gives an empty string."""
    lists = pairs.groupBy(query).agg(F.array_join(F.array_sort(F.collect_set(target)), ",").alias(out))
    return queries.select(query).distinct().join(lists, query, "left").select(query, F.coalesce(out, F.lit("")).alias(out))


def append_ledger(spark: SparkSession, path: str, entry: dict) -> None:
    """One more line in an append-only directory of JSON lines; null means not measured."""
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
