"""Deterministic stratified splits by hash rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.hashing import rank_key

NAMES = ("train", "tuning", "holdout")


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 42
    train_frac: float = 0.8
    tuning_frac: float = 0.1
    holdout_frac: float = 0.1

    def __post_init__(self) -> None:
        if abs(self.train_frac + self.tuning_frac + self.holdout_frac - 1.0) > 1e-9:
            raise ValueError("split fractions must sum to 1")


def assign_splits(rows: DataFrame, key: str, strata: tuple[str, ...], config: SplitConfig = SplitConfig()) -> DataFrame:
    """Adds `split`: within a stratum rows are ranked by hash, ties by key, and cut at the rounded (half to even) fractions.

    The rank is found without putting a stratum in one task: rows are counted by ranges of the hash, ranked
    within their range, and shifted by the rows of the ranges before.
    """
    hashed = rows.withColumn("_h", rank_key(config.seed, F.col(key)))
    ranged = hashed.withColumn("_range", F.substring("_h", 1, 2))
    counts = ranged.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    base = counts.withColumn("_total", F.sum("_n").over(w)).withColumn("_before", F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_h", key))
    ranked = ranged.withColumn("_rank", rank).join(base, [*strata, "_range"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    train = F.least(F.bround(F.col("_total") * F.lit(config.train_frac)), F.col("_total"))
    tuning = F.least(F.bround(F.col("_total") * F.lit(config.tuning_frac)), F.col("_total") - train)
    split = F.when(F.col("_rank") < train, NAMES[0]).when(F.col("_rank") < train + tuning, NAMES[1]).otherwise(NAMES[2])
    return ranked.withColumn("split", split).drop("_h", "_range", "_total", "_before", "_rank")


def split_counts(assigned: DataFrame) -> DataFrame:
    """One row for each of the three splits, zeros included."""
    names = assigned.sparkSession.createDataFrame([(n,) for n in NAMES], "split string")
    return names.join(assigned.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def fingerprint(assigned: DataFrame, key: str) -> DataFrame:
    """A SHA-256 of all `key<TAB>split` lines, whatever the order of rows and their number.

    Lines are dealt into 65,536 ranges by the first four hex digits of their key's own SHA-256, each range's sorted
    lines are hashed in a task of their own, and the digests of the ranges in order are hashed together.
    """
    lines = assigned.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 4).alias("part"), F.concat(F.col(key).cast("string"), F.lit("\t"), "split").alias("line"))
    digests = lines.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    return digests.agg(F.sha2(F.array_join(joined, "\n"), 256).alias("fingerprint"))


def save_manifest(assigned: DataFrame, key: str, config: SplitConfig, folder: str) -> dict:
    """The assignment as a published table and its header as `manifest.json` beside it; returns the header."""
    from kinloom.sources.sinks import publish_parquet, write_json

    publish_parquet(assigned.select(key, "split"), f"{folder}/assignment")
    header = manifest(assigned, key, config)
    write_json(assigned.sparkSession, f"{folder}/manifest.json", header)
    return header


def manifest(assigned: DataFrame, key: str, config: SplitConfig) -> dict:
    """Config, fingerprint and counts; the assignment itself is written as a table."""
    return {"config": vars(config) | {}, "fingerprint": fingerprint(assigned, key).first()[0], "counts": {r["split"]: r["n"] for r in split_counts(assigned).collect()}}
