"""Candidate retrieval: postings, inverse document frequencies, routes, fusion, budgets, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.arrays import jaccard
from kinloom.functions.hashing import unit_interval


#: Parts into which posting lists are dealt when none is left out.
SALTS = 16


def char_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Distinct character n-grams of the given sizes."""

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
        return F.when(F.length(c) >= n, F.transform(places, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[grams(n) for n in range(low, high + 1)]))


def postings(rows: DataFrame, key: str, tokens: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """(parts, token, key) without repeats."""
    return rows.select(*parts, F.explode(F.array_distinct(tokens)).alias("token"), key)


def document_frequencies(index: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    return index.groupBy(*parts, "token").agg(F.count("*").alias("df"))


def route(queries: DataFrame, index: DataFrame, n_docs: int, name: str, k: int, max_df: int | None, query: str = "qid", key: str = "id", parts: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, route, route_score, route_rank): the k best of each query by summed inverse document frequency.

    Tokens above max_df select nothing by themselves, so no long posting list is joined; with None every token counts,
    and posting lists are dealt by the hash of their keys. Ties go to the smaller id.
    """
    df = document_frequencies(index, parts)
    rare = (df if max_df is None else df.where(F.col("df") <= max_df)).withColumn("idf", F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1)))
    keys = [*parts, "token"]
    asked = queries.join(rare, keys)
    if max_df is None:
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        index, keys = index.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")), [*keys, "_salt"]
    hits = asked.join(index, keys).groupBy(query, key).agg(F.sum("idf").alias("route_score"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("route_score", 9)), key)
    return hits.withColumn("route_rank", F.row_number().over(best)).where(F.col("route_rank") <= k).withColumn("route", F.lit(name)).select(query, key, "route", "route_score", "route_rank")


def key_route(queries: DataFrame, targets: DataFrame, on: list[str], name: str, k: int, query: str = "qid", key: str = "id") -> DataFrame:
    """The first k candidates of each query, by key, that agree on selective keys (aliases, initials, street and number).

    They are among the first k targets of each value of `on`, so no more of them are joined: a value that many queries
    and many targets have makes no product.
    """
    first = targets.select(*on, key).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*on).orderBy(key))).where(F.col("_k") <= k).drop("_k")
    hits = queries.select(query, *on).distinct().join(first, on).select(query, key).distinct()
    ranked = hits.withColumn("route_rank", F.row_number().over(Window.partitionBy(query).orderBy(key)))
    return ranked.where(F.col("route_rank") <= k).select(query, key, F.lit(name).alias("route"), F.lit(1.0).alias("route_score"), "route_rank")


def fuse(routes: list[DataFrame], query: str = "qid", key: str = "id", constant: int = 60) -> DataFrame:
    """Routes united by pair: their ranks and scores by name, and the reciprocal-rank sum."""
    every = reduce(DataFrame.unionByName, routes)
    entry = F.struct(F.col("route_rank").alias("rank"), F.col("route_score").alias("score"))
    return every.groupBy(query, key).agg(F.sum(1.0 / (constant + F.col("route_rank"))).alias("rrf"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", entry.alias("at"))))).alias("routes"), F.min("route_rank").alias("best_rank"))


def budget(fused: DataFrame, k: int, query: str = "qid", key: str = "id", source: str | None = None, protected: int = 0) -> DataFrame:
    """The k best of each query (and source) by fused score; the first `protected` of every route come before others."""
    safe = (F.col("best_rank") <= protected).cast("int")
    part = [query, source] if source else [query]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(safe), F.desc(F.round("rrf", 9)), key))
    return fused.withColumn("final_candidate_rank", rank).where(F.col("final_candidate_rank") <= k)


def with_manifest(queries: DataFrame, candidates: DataFrame, query: str = "qid") -> DataFrame:
    """Every query, those without candidates with nulls."""
    return queries.select(query).distinct().join(candidates, query, "left")


def illustrative_score(names_a: Column, names_b: Column, address_a: Column, address_b: Column) -> Column:
    """The larger Jaccard and half the smaller."""
    n, a = jaccard(names_a, names_b), jaccard(address_a, address_b)
    return F.greatest(n, a) + 0.5 * F.least(n, a)


def pair_features(a: str, b: str) -> list[Column]:
    """Feature columns of pairs with token arrays `<side>_tokens`, `<side>_numbers` and texts `<side>_text`."""
    ta, tb, na, nb, xa, xb = (F.col(f"{s}_{c}") for c in ("tokens", "numbers", "text") for s in (a, b))
    smaller = F.least(F.size(F.array_distinct(ta)), F.size(F.array_distinct(tb)))
    return [
        (xa == xb).cast("int").alias("exact"), jaccard(ta, tb).alias("token_jaccard"), (F.size(F.array_intersect(ta, tb)) / F.nullif(smaller, F.lit(0))).alias("containment"),
        (F.least(F.length(xa), F.length(xb)) / F.nullif(F.greatest(F.length(xa), F.length(xb)), F.lit(0))).alias("length_ratio"), F.size(F.array_intersect(na, nb)).alias("numbers_agree"),
        (F.size(F.array_except(na, nb)) + F.size(F.array_except(nb, na))).alias("numbers_conflict"), F.levenshtein(xa, xb).alias("edit_distance"),
    ]


def retrieval_report(candidate_counts: DataFrame, n: str = "n_candidates", by: tuple[str, ...] = ()) -> DataFrame:
    """Queries, zero-hit rate and candidate counts (mean, p95, p99, max), by slices if given."""
    aggs = [
        F.count("*").alias("n_queries"), F.avg((F.col(n) == 0).cast("double")).alias("zero_hit_rate"), F.avg(n).alias("mean_candidates"),
        F.percentile(n, F.lit(0.95)).alias("p95"), F.percentile(n, F.lit(0.99)).alias("p99"), F.max(n).alias("max_candidates"),
    ]
    return candidate_counts.groupBy(*by).agg(*aggs) if by else candidate_counts.agg(*aggs)


def recall_report(truth_pairs: DataFrame, candidates: DataFrame, slices: tuple[str, ...] = (), query: str = "qid", key: str = "id") -> DataFrame:
    """True pairs, those found, recall, and pairs found by one route only, by slices if given. `truth_pairs` may carry the slices; `candidates` has `routes` as fuse makes it."""
    rows = truth_pairs.join(candidates.select(query, key, F.map_keys("routes").alias("by")), [query, key], "left")
    aggs = [F.count("*").alias("n_true"), F.count("by").alias("n_found"), F.avg(F.col("by").isNotNull().cast("double")).alias("recall"), F.count_if(F.size("by") == 1).alias("one_route_only")]
    return rows.groupBy(*slices).agg(*aggs) if slices else rows.agg(*aggs)


def loss_by_fate(truth_pairs: DataFrame, candidates: DataFrame, accepted: DataFrame, query: str = "qid", key: str = "id") -> DataFrame:
    """(fate, n, loss): what each kind of error takes from macro F0.5. A query's loss is shared equally by its errors."""
    t, c, a = (d.select(query, key).distinct().withColumn(m, F.lit(True)) for d, m in ((truth_pairs, "t"), (candidates, "c"), (accepted, "a")))
    rows = t.join(c, [query, key], "full").join(a, [query, key], "full")
    fate = F.when(F.col("t") & F.col("a"), "matched").when(F.col("t") & F.col("c"), "rejected").when(F.col("t"), "unretrieved").when(F.col("a"), "wrongly_accepted")
    each = rows.withColumn("fate", fate).where("fate IS NOT NULL")
    n = {f: F.count_if(F.col("fate") == f) for f in ("matched", "rejected", "unretrieved", "wrongly_accepted")}
    by_query = each.groupBy(query).agg(*[v.alias(f) for f, v in n.items()])
    missed, wrong = F.col("rejected") + F.col("unretrieved"), F.col("wrongly_accepted")
    score = F.when((F.col("matched") + missed == 0) | (F.col("matched") + wrong == 0), F.lit(0.0)).otherwise(1.25 * F.col("matched") / (1.25 * F.col("matched") + 0.25 * missed + wrong))
    shares = by_query.withColumn("share", (1 - score) / F.nullif(missed + wrong, F.lit(0)))
    total = shares.agg(*[F.sum(F.when(F.col(f) > 0, F.col(f) * F.col("share")).otherwise(0.0)).alias(f"l_{f}") for f in n if f != "matched"], *[F.sum(f).alias(f) for f in n], F.count("*").alias("q"))
    return total.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fate"), F.col(f).alias("n"), (F.lit(0.0) if f == "matched" else F.coalesce(F.col(f"l_{f}"), F.lit(0.0)) / F.col("q")).alias("loss")) for f in n])))


def sliced_macro(scored: DataFrame, slices: DataFrame, by: str, query: str = "qid", score: str = "score") -> DataFrame:
    """Macro score and queries of each slice (transfer between countries, missing or corrupted fields); queries without a slice are left out."""
    return scored.join(slices.select(query, by), query).groupBy(by).agg(F.avg(score).alias("macro"), F.count("*").alias("n_queries"))


def hard_negatives(candidates: DataFrame, truth_pairs: DataFrame, held_out: DataFrame, k: int = 20, query: str = "qid", key: str = "id") -> DataFrame:
    """The k best candidates of each query that are no matches, without held-out queries."""
    free = candidates.join(truth_pairs, [query, key], "left_anti").join(held_out, query, "left_anti")
    return free.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy("final_candidate_rank", key))).where(F.col("_k") <= k).drop("_k")


def error_budget(truth_pairs: DataFrame, candidates: DataFrame, accepted: DataFrame, query: str = "qid", key: str = "id") -> DataFrame:
    """Pairs by fate: matched, rejected, unretrieved, wrongly accepted."""
    t, c, a = (d.select(query, key).distinct().withColumn(m, F.lit(True)) for d, m in ((truth_pairs, "t"), (candidates, "c"), (accepted, "a")))
    rows = t.join(c, [query, key], "full").join(a, [query, key], "full")
    fate = F.when(F.col("t") & F.col("a"), "matched").when(F.col("t") & F.col("c"), "rejected").when(F.col("t"), "unretrieved").when(F.col("a"), "wrongly_accepted").otherwise("correctly_rejected")
    return rows.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def threshold_sweep(scored_pairs: DataFrame, truth: DataFrame, thresholds: list[float], query: str = "qid", key: str = "id") -> DataFrame:
    """Macro F0.5 at each threshold of a short list; pairs are accepted one by one."""
    from kinloom.operators.metrics import f_beta

    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    kept = scored_pairs.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("score >= threshold")
    preds = kept.groupBy(query, "threshold").agg(F.collect_set(F.col(key).cast("string")).alias("pred_ids"))
    rows = truth.select(F.col("qid").alias(query), F.col("ids").alias("true_ids"), grid).join(preds, [query, "threshold"], "left")
    pred = F.coalesce("pred_ids", F.array().cast("array<string>"))
    return rows.groupBy("threshold").agg(F.avg(f_beta(F.col("true_ids"), pred)).alias("macro_f05"))


def paired_bootstrap(scores: DataFrame, unit: str, delta: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Replicate means of a score difference under Poisson(1) weights drawn from hashes; the table isn't copied to the driver."""
    u = F.col("u")
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        cuts.append(F.when(u >= total, 1).otherwise(0))
        term /= k + 1
    weight = reduce(lambda x, y: x + y, cuts)
    rows = scores.select(unit, delta, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    rows = rows.withColumn("u", unit_interval(seed, F.concat(F.col(unit).cast("string"), F.lit(":"), F.col("replicate").cast("string")))).withColumn("w", weight)
    return rows.groupBy("replicate").agg((F.sum(F.col("w") * F.col(delta)) / F.nullif(F.sum("w"), F.lit(0))).alias("mean_delta"))
