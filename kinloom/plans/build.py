"""The build: source tables, truth, families, splits and their report, in one folder."""

from __future__ import annotations

import resource
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import splits, truth
from kinloom.sources.sinks import ingest_to_parquet, publish_parquet, write_json
from kinloom.sources.tsv import read_truth, with_row_number


def peak_memory_gib() -> float:
    """Largest resident set of the driver's Python so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1 << 20)


def truth_counts(rows: DataFrame, entries: DataFrame, family: DataFrame) -> DataFrame:
    """One row: truth rows, ids, ids without a match, edges, offending entries, targets of several owners, families."""
    good = truth.edges(entries)
    ids = rows.select(F.col("source1_entity_id").alias("s1_id")).distinct()
    parts = [
        rows.agg(F.count("*").alias("n_rows")), ids.agg(F.count("*").alias("n_ids")), ids.join(good, "s1_id", "left_anti").agg(F.count("*").alias("singletons")), good.agg(F.count("*").alias("edges")),
        entries.where("status <> 'ok'").agg(F.count("*").alias("errors")), truth.multi_owner_targets(good).agg(F.count("*").alias("multi_owner")), family.agg(F.count_distinct("family_id").alias("families")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # single rows
    return out


def build(spark: SparkSession, sources: dict[str, str], truth_path: str, out: str, config: splits.SplitConfig = splits.SplitConfig()) -> dict:
    """Writes S1, S2, ..., truth, families and splits below `out` and the report `build_report.json`, which is returned.

    Files are tab-separated; `sources` maps labels to paths, S1 among them. Families are split as units, by their country.
    """
    stages: list[dict] = []

    def stage(name: str, run) -> dict:
        began = time.time()
        found = run() or {}
        stages.append({"stage": name, "seconds": round(time.time() - began, 2), **found})
        return found

    for label, path in sources.items():
        stage(f"ingest_{label}", lambda label=label, path=path: ingest_to_parquet(spark, path, label, f"{out}/{label}"))
    s1 = spark.read.parquet(f"{out}/S1")
    stage("truth_rows", lambda: publish_parquet(with_row_number(read_truth(spark, truth_path)), f"{out}/truth_rows"))
    rows = spark.read.parquet(f"{out}/truth_rows")
    stage("truth_entries", lambda: publish_parquet(truth.parse_entries(rows), f"{out}/truth_entries"))
    entries = spark.read.parquet(f"{out}/truth_entries")
    stage("truth", lambda: publish_parquet(truth.truth_sets(rows), f"{out}/truth"))
    stage("families", lambda: publish_parquet(truth.families(s1.select(F.col("entity_id").alias("s1_id")), truth.edges(entries)), f"{out}/families"))
    family = spark.read.parquet(f"{out}/families")
    stage("counts", lambda: truth_counts(rows, entries, family).first().asDict())
    stage("family_countries", lambda: publish_parquet(truth.family_countries(family, s1), f"{out}/family_countries"))

    def split() -> dict:
        assigned = splits.assign_splits(spark.read.parquet(f"{out}/family_countries").select("family_id", "country"), "family_id", ("country",), config)
        return splits.save_manifest(assigned, "family_id", config, f"{out}/splits")

    stage("splits", split)
    report = {"stages": stages, "peak_driver_gib": round(peak_memory_gib(), 3), "seconds": round(sum(s["seconds"] for s in stages), 2)}
    write_json(spark, f"{out}/build_report.json", report)
    return report
