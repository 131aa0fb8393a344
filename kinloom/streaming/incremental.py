"""Streaming forms of ingestion and of the duplicate check: the same rules on data that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.operators.truth import split_ids
from kinloom.sources.tsv import TRUTH_COLUMNS, target_source


def truth_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Truth rows of the tab-separated files that arrive in a folder."""
    schema = ", ".join(f"{c} string" for c in TRUTH_COLUMNS)
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).csv(folder).na.fill("")


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table as a stream."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def first_seen(rows: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not been seen; with an event time, state is kept for `late` only."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def owner_counts(rows: DataFrame) -> DataFrame:
    """Running number of owners of each target."""
    entries = rows.select(F.explode(split_ids(F.col("matched_entity_ids"))).alias("target_id")).where(target_source(F.col("target_id")).isNotNull())
    return entries.groupBy("target_id").agg(F.count("*").alias("n_owners"))


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and key, closed as the watermark passes."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def run_available(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result table, which is written to the folder batch by batch.

    A batch that is repeated after a failure overwrites its own part. In mode `complete` the last batch is the result.
    """
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number:09d}")

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{folder}/rows")
    return (found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]) if mode == "complete" else found).drop("batch")
