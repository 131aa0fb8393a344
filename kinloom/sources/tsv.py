"""Tab-separated tables: source records, id lists, plain lines. Blank fields are empty strings, never null."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there something at the path, in any store Spark can read?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _scan(spark: SparkSession, path: str, mode: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("mode", mode).option("encoding", "UTF-8")
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def _named(df: DataFrame, required: tuple[str, ...], path: str) -> DataFrame:
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"{path} is missing expected columns {lacking}")
    return df


def read_columns(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The named columns, all strings, in the given order; others are dropped, short rows are filled with empty strings."""
    return _named(_scan(spark, path, "PERMISSIVE"), columns, path).select(*columns).na.fill("")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, SOURCE_COLUMNS)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, TRUTH_COLUMNS)


def read_rows(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns; a row with too few or too many fields fails the job, `malformed_rows` tells which."""
    head = _named(_scan(spark, path, "PERMISSIVE"), required, path)
    return _scan(spark, path, "FAILFAST", T.StructType([T.StructField(c, T.StringType()) for c in head.columns])).na.fill("")


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, n_fields, expected) of the lines with another number of fields than the header; the header is line 1.

    For files without quoted line breaks: a line is a row.
    """
    lines = numbered_lines(spark, path).select("line_number", F.size(F.split("value", "\t")).alias("n_fields"))
    head = F.broadcast(lines.where("line_number = 1").select(F.col("n_fields").alias("expected")))  # one row
    return lines.where("line_number > 1").join(head, F.col("n_fields") != F.col("expected")).select("line_number", "n_fields", "expected")


def checked_rows(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """Like read_rows; the first malformed row is named by its line."""
    if bad := malformed_rows(spark, path).orderBy("line_number").head(1):
        raise ValueError(f"{path}, line {bad[0]['line_number']}: {bad[0]['n_fields']} fields, the header has {bad[0]['expected']}")
    return read_rows(spark, path, required)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first fields of the lines after the header, stripped; blank lines are skipped."""
    lines = numbered_lines(spark, path).where("line_number > 1")
    value = F.regexp_replace(F.substring_index("value", "\t", 1), r"(?U)^\s+|\s+$", "")
    return lines.where(F.regexp_replace("value", r"(?U)\s+", "") != "").select(value.alias("id")).distinct()


def read_match_targets(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame | None:
    """Ids of all target files, or None and a warning if one of them is not there."""
    if gone := [p for p in paths if not exists(spark, p)]:
        warnings.warn(f"no target check, files are missing: {gone}", stacklevel=2)
        return None
    out = read_ids(spark, paths[0])
    for p in paths[1:]:
        out = out.unionByName(read_ids(spark, p))
    return out.distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (no quoting) as (line_number from 1, value), numbered in file order."""
    return with_row_number(spark.read.text(path), "line_number", start=1)


def with_row_number(df: DataFrame, column: str = "row_id", start: int = 0, order: tuple = ()) -> DataFrame:
    """Rows numbered without gaps: by `order` if given, else as they lie in the scan.

    Every partition is counted, and numbered from the sum of those before it; no row is moved for that. With an
    order, rows are first dealt out by ranges of it.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return tagged.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("_at", "_part", "_before")


def ingest(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Source records with row_id (from 0, file order) and source label in front."""
    rows = with_row_number(read_source(spark, path)).withColumn("source", F.lit(label))
    return rows.select(F.col("row_id").cast("long").alias("row_id"), "source", *SOURCE_COLUMNS)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def target_source(id_column) -> Column:
    """S2 or S3 from an id's prefix, else null."""
    return F.when(F.startswith(id_column, F.lit("S2-")), "S2").when(F.startswith(id_column, F.lit("S3-")), "S3")


def prefix(id_column) -> Column:
    return F.substring_index(id_column, "-", 1)


def entity_index(ingested: DataFrame) -> DataFrame:
    """entity_id -> row_id, the last of repeated ids."""
    return ingested.groupBy("entity_id").agg(F.max("row_id").alias("row_id"))
