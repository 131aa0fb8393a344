"""Strict and lenient checks of id-list files, as one table of violations (file, rule, offender)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.truth import split_ids
from kinloom.sources.tsv import exists, numbered_lines, target_source

MATCHING_HEADER, CANDIDATE_HEADER = "source1_entity_id\tmatched_entity_ids", "source1_entity_id\tcandidate_entity_ids"
SCHEMA = "file string, rule string, offender string"


def _rows(spark: SparkSession, file: str, rule: str, offender: str) -> DataFrame:
    return spark.createDataFrame([(file, rule, offender)], SCHEMA)


def _named(df: DataFrame, file: str, rule: str, offender) -> DataFrame:
    return df.select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), offender.cast("string").alias("offender"))


def list_violations(rows: DataFrame, file: str, required: DataFrame | None, valid_targets: DataFrame | None) -> DataFrame:
    """Violations of parsed rows (s1_id, ids array as written). required and valid_targets have a column id."""
    out = _named(rows.groupBy("s1_id").count().where("count > 1"), file, "duplicate_row", F.col("s1_id"))
    entries = rows.select("s1_id", F.explode("ids").alias("id"))
    twice = rows.where(F.size("ids") != F.size(F.array_distinct("ids")))
    out = out.unionByName(_named(twice, file, "duplicate_id_in_list", F.col("s1_id")))
    status = F.when(F.startswith("id", F.lit("S1-")), "self_match").when(target_source(F.col("id")).isNull(), "wrong_prefix")
    marked = entries.withColumn("rule", status)
    out = out.unionByName(marked.where("rule IS NOT NULL").select(F.lit(file).alias("file"), "rule", F.concat_ws(":", "s1_id", "id").alias("offender")))
    if valid_targets is not None:
        unknown = marked.where("rule IS NULL").join(valid_targets, "id", "left_anti")
        out = out.unionByName(_named(unknown, file, "unknown_id", F.concat_ws(":", "s1_id", "id")))
    if required is not None:
        seen = rows.select(F.col("s1_id").alias("id")).distinct()
        out = out.unionByName(_named(required.join(seen, "id", "left_anti"), file, "missing_required", F.col("id")))
        out = out.unionByName(_named(seen.join(required, "id", "left_anti"), file, "extra_row", F.col("id")))
    return out


def parse_file(spark: SparkSession, path: str, header: str, file: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows, violations) of a file read line by line without quoting; rows is None where the file can't be read on."""
    if not exists(spark, path):
        return None, _rows(spark, file, "not_found", path)
    lines = numbered_lines(spark, path)
    first = lines.where("line_number = 1").first()
    if first is None:
        return None, _rows(spark, file, "empty_file", path)
    if first["value"].strip().lower() != header:
        hint = "comma_separated_header" if "," in first["value"] and "\t" not in first["value"] else "bad_header"
        return None, _rows(spark, file, hint, first["value"])
    body = lines.where("line_number > 1").where(F.regexp_replace("value", r"(?U)\s+", "") != "")
    bad = _named(body.where(F.instr("value", "\t") == 0), file, "malformed_row", F.col("line_number"))
    rows = body.where(F.instr("value", "\t") > 0).select(
        F.substring_index("value", "\t", 1).alias("s1_id"), split_ids(F.expr("substring(value, instr(value, '\t') + 1)"), trim=False).alias("ids"), "line_number",
    )
    return rows, bad


def subset_violations(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched ids that are not candidates of the same query. Of repeated rows the last counts."""
    last = lambda rows: rows.groupBy("s1_id").agg(F.max_by("ids", "line_number").alias("ids")).select("s1_id", F.explode("ids").alias("id"))
    extra = last(matching).join(last(candidates), ["s1_id", "id"], "left_anti")
    return _named(extra, "matching", "retrieval_lineage", F.concat_ws(":", "s1_id", "id"))


def validate_outputs(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, valid_targets: DataFrame | None, strict: bool = True) -> tuple[DataFrame, int]:
    """(violations with severity, rows of both files). Lenient: an absent candidate file and lineage breaks are warnings."""
    rows, found = parse_file(spark, matching, MATCHING_HEADER, "matching")
    count = 0
    if rows is not None:
        found, count = found.unionByName(list_violations(rows, "matching", required, valid_targets)), rows.count()
    if candidate is not None and (strict or exists(spark, candidate)):
        others, bad = parse_file(spark, candidate, CANDIDATE_HEADER, "candidate")
        found = found.unionByName(bad)
        if others is not None:
            found, count = found.unionByName(list_violations(others, "candidate", required, valid_targets)), count + others.count()
            if rows is not None:
                found = found.unionByName(subset_violations(rows, others))
    elif not strict:
        found = found.unionByName(_rows(spark, "candidate", "not_given", ""))
    soft = F.col("rule").isin("retrieval_lineage", "not_given")
    return found.withColumn("severity", F.when(soft & F.lit(not strict), "warning").otherwise("error")), count


def is_ok(violations: DataFrame) -> bool:
    return violations.where("severity = 'error'").isEmpty()


def examples(violations: DataFrame, k: int = 10) -> DataFrame:
    """Per file and rule: how many, and the first k offenders in order."""
    return violations.groupBy("file", "rule").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("offender")), 1, k).alias("first"))
