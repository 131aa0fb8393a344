"""Exact-size samples, linked records, greedy coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.hashing import rank_key
from kinloom.operators.truth import split_ids
from kinloom.sources.tsv import prefix


def sample_rows(rows: DataFrame, key: str, size: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly `size` rows, uniform and determined by seed and key; fewer are an error if strict."""
    out = rows.orderBy(rank_key(seed, F.col(key).cast("string")), key).limit(size)
    if strict and (have := out.count()) < size:
        raise ValueError(f"asked for {size} rows, the table has {have}")
    return out


def shuffled(rows: DataFrame, key: str, seed: int = 43) -> DataFrame:
    return rows.orderBy(rank_key(seed, F.col(key).cast("string")), key)


def select_rows(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is wanted (column id); repeated and absent keys are errors."""
    out = rows.join(wanted.select(F.col("id").alias(key)), key, "left_semi")
    twice = [r[0] for r in out.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated keys: {twice}")
    gone = [r[0] for r in wanted.join(rows.select(F.col(key).alias("id")), "id", "left_anti").orderBy("id").limit(5).collect()]
    if gone:
        raise ValueError(f"keys not found: {gone}")
    return out


def linked_sample(s1: DataFrame, truth: DataFrame, targets: dict[str, DataFrame], size: int, seed: int = 42) -> dict[str, DataFrame]:
    """A sample of S1 rows with their truth rows and the target records these name; all is checked before anything is returned."""
    picked = shuffled(sample_rows(s1, "entity_id", size, seed), "entity_id")
    ids = picked.select(F.col("entity_id").alias("id"))
    lists = select_rows(truth, "source1_entity_id", ids)
    named = lists.select(F.explode(split_ids(F.col("matched_entity_ids"))).alias("id")).distinct()
    out = {"S1": picked, "truth": lists}
    for label, records in targets.items():
        out[label] = select_rows(records, "entity_id", named.where(prefix(F.col("id")) == label))
    return out


def missing_references(entries: DataFrame, records: DataFrame, key: str, record_key: str) -> DataFrame:
    return entries.select(F.col(key).alias("id")).distinct().join(records.select(F.col(record_key).alias("id")), "id", "left_anti")


def greedy_coverage(labelled: DataFrame, size: int, seed: int = 42, key: str = "entity_id", labels: str = "labels", quotas: tuple[int, ...] = (1, 2)) -> list[str]:
    """Entities that cover the labels, rarest label first, to each quota in turn; then the rest by hash. At most `size`.

    The labels are a fixed list of a few dozen, so the driver's loop is short; each pick is a minimum over the table.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(labels).alias("l"), rank_key(seed, F.col(key)).alias("h"))
    counts = [(r["n"], r["label"]) for r in rows.select("k", F.explode("l").alias("label")).groupBy("label").agg(F.count_distinct("k").alias("n")).collect()]
    chosen: list[str] = []
    have: dict[str, int] = {}

    def take(where: Column) -> bool:
        free = rows.where(where & ~F.col("k").isin(*chosen)) if chosen else rows.where(where)
        best = free.agg(F.min_by(F.struct("k", "l"), F.struct("h", "k")).alias("b")).first()["b"]
        if best is None:
            return False
        chosen.append(best["k"])
        for label in best["l"]:
            have[label] = have.get(label, 0) + 1
        return True

    for quota in quotas:
        for _, label in sorted(counts):
            while len(chosen) < size and have.get(label, 0) < quota and take(F.array_contains("l", label)):
                pass
    if len(chosen) < size:  # the rest by hash, at once
        free = rows.where(~F.col("k").isin(*chosen)) if chosen else rows
        chosen += [r["k"] for r in free.orderBy("h", "k").limit(size - len(chosen)).collect()]
    return chosen
