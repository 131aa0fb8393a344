"""Set scores of predicted id lists against truth. Frames have (qid, ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def f_beta(truth: Column, pred: Column, beta: float = 0.5) -> Column:
    """F-beta of two id arrays; both empty 1, one empty 0."""
    t, p = F.array_distinct(truth), F.array_distinct(pred)
    tp = F.size(F.array_intersect(t, p))
    b2 = beta * beta
    score = (1 + b2) * tp / F.nullif((1 + b2) * tp + b2 * (F.size(t) - tp) + (F.size(p) - tp), F.lit(0.0))
    return F.when((F.size(t) == 0) & (F.size(p) == 0), F.lit(1.0)).when((F.size(t) == 0) | (F.size(p) == 0), F.lit(0.0)).otherwise(score)


def _joined(truth: DataFrame, found: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return truth.select("qid", F.col("ids").alias("true_ids")).join(found.select("qid", F.col("ids").alias("pred_ids")), "qid", "left").withColumn("pred_ids", F.coalesce("pred_ids", empty))


def _few(df: DataFrame) -> list:
    return [r[0] for r in df.orderBy("qid").limit(5).collect()]


def check_queries(truth: DataFrame, predictions: DataFrame, queries: DataFrame) -> None:
    """Raises for repeated queries, queries without truth and queries without a prediction; the first five are named."""
    if bad := _few(queries.groupBy("qid").count().where("count > 1").select("qid")):
        raise ValueError(f"repeated query ids: {bad}")
    if bad := _few(queries.select("qid").join(truth, "qid", "left_anti")):
        raise ValueError(f"query ids without truth: {bad}")
    if bad := _few(queries.select("qid").join(predictions, "qid", "left_anti")):
        raise ValueError(f"query ids without a prediction: {bad}")


def score_queries(truth: DataFrame, predictions: DataFrame, queries: DataFrame | None = None, beta: float = 0.5, strict: bool = True) -> DataFrame:
    """(qid, true_ids, pred_ids, score) of each query; strict checks first."""
    queries = truth.select("qid") if queries is None else queries.select("qid")
    if strict:
        check_queries(truth, predictions, queries)
    return _joined(truth.join(queries.distinct(), "qid", "left_semi"), predictions).withColumn("score", f_beta(F.col("true_ids"), F.col("pred_ids"), beta))


def macro_mean(scored: DataFrame, name: str = "macro_f05") -> DataFrame:
    return scored.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias(name))


def candidate_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """micro_recall, macro_recall, n_queries over queries with a non-empty truth, in one pass; NaN if there are none. Missing candidates are empty."""
    rows = _joined(truth.where(F.size("ids") > 0), candidates)
    hit, size = F.size(F.array_intersect("true_ids", "pred_ids")), F.size(F.array_distinct("true_ids"))
    nan = F.lit(NAN)
    return rows.agg(
        F.coalesce(F.sum(hit) / F.nullif(F.sum(size), F.lit(0)), nan).alias("micro_recall"), F.coalesce(F.avg(hit / size), nan).alias("macro_recall"), F.count("*").alias("n_queries"),
    )


def complete_coverage(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of queries with a non-empty truth whose whole truth is among the candidates."""
    rows = _joined(truth.where(F.size("ids") > 0), candidates)
    return rows.agg(F.coalesce(F.avg((F.size(F.array_except("true_ids", "pred_ids")) == 0).cast("double")), F.lit(NAN)).alias("coverage"))


def oracle_scores(truth: DataFrame, candidates: DataFrame, beta: float = 0.5) -> DataFrame:
    """Scores of the best prediction that the candidates allow: their intersection with the truth."""
    rows = _joined(truth, candidates).withColumn("pred_ids", F.array_intersect("true_ids", "pred_ids"))
    return rows.withColumn("score", f_beta(F.col("true_ids"), F.col("pred_ids"), beta))
