"""Scoring of candidate pairs in batches that can be resumed, and acceptance pair by pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.sources.sinks import publish_parquet
from kinloom.sources.tsv import exists


def score_batches(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, key: str, batches: int, stop_after: int | None = None) -> DataFrame:
    """All scored pairs, written to `out` batch by batch: batches are dealt by a hash of the key, and those that are there already are not scored again.

    What is scored is what is written: the candidates of a batch stand beside its scores. A batch appears as a whole or not at all.
    """
    spark = pairs.sparkSession
    written = 0
    for k in range(batches):
        if exists(spark, f"{out}/scores/batch={k}"):
            continue
        if stop_after is not None and written >= stop_after:
            break
        part = pairs.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        publish_parquet(part, f"{out}/candidates/batch={k}")
        publish_parquet(score(spark.read.parquet(f"{out}/candidates/batch={k}")), f"{out}/scores/batch={k}")
        written += 1
    return spark.read.parquet(f"{out}/scores").drop("batch")


def accepted(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Every pair of at least this score, by itself: a query may have none, one or many."""
    return scored.where(F.col(score) >= threshold)


def fit_pair_classifier(pairs: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 42):
    """A gradient-boosted classifier of pairs; returns a function that adds `score`, the probability of a match. Missing features count as -1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gather = VectorAssembler(inputCols=features, outputCol="_x")
    rows = lambda df: gather.transform(df.na.fill(-1.0, features))
    model = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=trees, maxDepth=depth, seed=seed).fit(rows(pairs.withColumn(label, F.col(label).cast("double"))))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(rows(df)).withColumn("score", vector_to_array("probability")[1])
        return out.drop("_x", "rawPrediction", "probability", "prediction")

    return score


def fit_calibration(scored: DataFrame, source: str, label: str = "label", score: str = "score"):
    """An isotonic calibration for each source; returns a function that replaces the scores. Sources are few: each has a model of its own."""
    from pyspark.ml.regression import IsotonicRegression

    rows = scored.select(source, F.col(label).cast("double").alias("label"), F.col(score).alias("features"))
    sources = [r[0] for r in rows.select(source).distinct().orderBy(source).limit(1000).collect()]
    models = {s: IsotonicRegression().fit(rows.where(F.col(source) == s)) for s in sources}

    def calibrate(df: DataFrame) -> DataFrame:
        out = df.withColumn("_old", F.col(score)).drop(score)
        value = F.col("_old")
        for s, m in models.items():
            xs, ys = m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()
            value = F.when(F.col(source) == s, _between(F.col("_old"), xs, ys)).otherwise(value)
        return out.withColumn(score, value).drop("_old")

    return calibrate


def _between(x, xs: list[float], ys: list[float]):
    """Straight lines between the points, flat outside."""
    points = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(xs, ys, strict=True)])
    low = F.array_max(F.filter(points, lambda p: p["a"] <= x))
    high = F.array_min(F.filter(points, lambda p: p["a"] >= x))
    line = low["b"] + (high["b"] - low["b"]) * (x - low["a"]) / F.nullif(high["a"] - low["a"], F.lit(0.0))
    return F.coalesce(F.when(low.isNull(), high["b"]), F.when(high.isNull(), low["b"]), line, low["b"])
