"""All queries over the linkage operators, with their DuckDB oracles.

The driver's tables stand in for linkage data: orders are queries, their line items' parts are matched ids.
Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import arrays as A
from kinloom.functions import text as X
from kinloom.functions import unicode as U
from kinloom.functions.hashing import unit_interval
from kinloom.operators import metrics, retrieve, sample, splits, truth, validate, variation
from kinloom.session import table
from kinloom.sources import sinks
from kinloom.sources.tsv import prefix, with_row_number
from kinloom.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def queries() -> dict:
    from kinloom.plans import more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from kinloom.plans import more  # noqa: F401

    return dict(ORACLES)


# Census, row numbers, scalar functions


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def census_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    return with_row_number(table(spark, d, "documents").select("doc_id"), order=("doc_id",))


@query(r"""SELECT doc_id, text IS NULL OR regexp_full_match(text, '[\s]*') AS missing,
  lower(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))) IN ('', 'null', 'none', 'nan', 'n/a') AS null_field FROM documents""")
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.is_missing(F.col("text")).alias("missing"), X.is_null_field(F.col("text")).alias("null_field"))


@query(r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)""")
def tokens_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.words(F.lower("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(r"SELECT page_id, array_to_string(regexp_extract_all(url, '\p{Nd}+'), ' ') AS numbers FROM pages")
def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(X.numeric_tokens(F.col("url")), " ").alias("numbers"))


#: Words of part names that the reduced view drops from the end.
TRADE_WORDS = ("ring", "bolt", "widget", "gear", "nut", "screw", "plate", "rod")


@query(rf"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}]+') AS w FROM part),
  k AS (SELECT p_partkey, w, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN {TRADE_WORDS} THEN 0 ELSE i END)), 0) AS n FROM t)
  SELECT p_partkey, array_to_string(w[1:n], ' ') AS reduced, array_to_string(list_transform(w, lambda x: x[1]), '') AS initials FROM k""")
def legal_reduced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.legal_form_reduced(F.col("p_name"), TRADE_WORDS).alias("reduced"), X.initials(F.col("p_name")).alias("initials"))


@query("SELECT lower(trim(c_mktsegment)) AS country, count(*) AS n FROM customer GROUP BY 1")
def country_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(X.normalize_country(F.col("c_mktsegment")).alias("country")).agg(F.count("*").alias("n"))


@query("SELECT split_part(o_orderpriority, '-', 1) AS prefix, count(*) AS n FROM orders GROUP BY 1")
def prefix_router(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(prefix(F.col("o_orderpriority")).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(CAST(CAST('0x' || substr(sha256('42:' || o_orderkey), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0, 9) AS u FROM orders")
def unit_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(unit_interval(42, F.col("o_orderkey").cast("string")), 9).alias("u"))


@query("""SELECT p_name, CAST(len(list_distinct(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(p_name) - n + 2, 1)), lambda i: substr(p_name, i, n)))))) AS INTEGER) AS n_grams
  FROM (SELECT DISTINCT p_name FROM part)""")
def char_grams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_name").distinct().select("p_name", F.size(retrieve.char_grams(F.col("p_name"))).alias("n_grams"))


# Id lists, edges, families

_LISTS = """lists AS (SELECT l_orderkey AS k, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem GROUP BY 1)"""


@query(f"WITH {_LISTS}, e AS (SELECT k, unnest(string_split(ids, ',')) AS id FROM lists) SELECT k AS l_orderkey, count(*) AS n, min(id) AS low, max(id) AS high FROM e GROUP BY 1")
def idlist_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("id"))
    lists = sinks.id_lists(items, items, "l_orderkey", "id", "ids")
    back = lists.select("l_orderkey", F.explode(truth.split_ids(F.col("ids"))).alias("id"))
    return back.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


_ENTRY = "CASE l_returnflag WHEN 'R' THEN 'S2-' WHEN 'A' THEN 'S3-' WHEN 'N' THEN CASE WHEN l_linenumber = 1 THEN 'S1-' WHEN l_linenumber = 2 THEN 'X9-' ELSE 'S2-' END END || CAST(l_partkey % 7 AS {s})"


def _truth_rows(spark: SparkSession, d: str) -> DataFrame:
    """Id lists with entries of every status, one row for each order."""
    items = table(spark, d, "lineitem").select(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("source1_entity_id"), F.col("l_orderkey").alias("row_id"), F.expr(_ENTRY.format(s="STRING")).alias("id"))
    return items.groupBy("source1_entity_id", "row_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("matched_entity_ids"))


_STATUSES = f"""e AS (SELECT l_orderkey, {_ENTRY.format(s="VARCHAR")} AS id FROM lineitem),
  s AS (SELECT l_orderkey, id, CASE WHEN id LIKE 'S1-%' THEN 'self_match' WHEN id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%' THEN 'bad_prefix'
    WHEN row_number() OVER (PARTITION BY l_orderkey, id) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM e)"""


@query(f"WITH {_STATUSES} SELECT status, count(*) AS n FROM s GROUP BY 1")
def parse_statuses(spark: SparkSession, d: str) -> DataFrame:
    return truth.parse_entries(_truth_rows(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_STATUSES} SELECT 'S1-' || l_orderkey AS qid, coalesce(string_agg(id, ',' ORDER BY id) FILTER (status = 'ok'), '') AS ids FROM s GROUP BY l_orderkey""")
def truth_sets(spark: SparkSession, d: str) -> DataFrame:
    return truth.truth_sets(_truth_rows(spark, d)).select("qid", F.array_join("ids", ",").alias("ids"))


@query("SELECT l_partkey AS target_id, count(DISTINCT l_orderkey) AS n_owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def multi_owner(spark: SparkSession, d: str) -> DataFrame:
    return truth.multi_owner_targets(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target_id")).distinct())


@query("""WITH RECURSIVE n AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents),
  e AS (SELECT CAST(doc_id AS VARCHAR) AS s, 't' || md5(text) AS t FROM documents UNION SELECT CAST(doc_id AS VARCHAR), 'n' || source || '/' || n_chars FROM documents),
  p AS (SELECT DISTINCT a.s AS u, b.s AS v FROM e a JOIN e b USING (t)),
  r(u, v) AS (SELECT s, s FROM n UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.v)
  SELECT u AS node, min(v) AS family_id FROM r GROUP BY 1""")
def families(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("s1_id"), "text", "source", "n_chars")
    by_text = docs.select("s1_id", F.concat(F.lit("t"), F.md5("text")).alias("target_id"))
    by_size = docs.select("s1_id", F.concat(F.lit("n"), "source", F.lit("/"), F.col("n_chars").cast("string")).alias("target_id"))
    return truth.families(docs, by_text.unionByName(by_size))


@query("""SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*) AS n_rows FROM events GROUP BY 1""")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"), F.count("*").alias("n_rows"))


# Splits

_SPLIT = """r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY substr(sha256('42:' || o_orderkey), 1, 16), CAST(o_orderkey AS VARCHAR)) - 1 AS i,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  s AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority, CASE WHEN i < round_even(n * 0.8, 0) THEN 'train' WHEN i < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'tuning' ELSE 'holdout' END AS split FROM r)"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority"), "k", ("o_orderpriority",))


@query(f"WITH {_SPLIT} SELECT k, o_orderpriority, split FROM s")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


@query(f"WITH {_SPLIT} SELECT split, count(*) AS n FROM s GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_counts(_assigned(spark, d))


@query(f"""WITH {_SPLIT}, p AS (SELECT substr(sha256(k), 1, 4) AS part, sha256(string_agg(k || chr(9) || split, chr(10) ORDER BY k || chr(9) || split)) AS digest FROM s GROUP BY 1)
  SELECT sha256(string_agg(digest, chr(10) ORDER BY part)) AS fingerprint FROM p""")
def split_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return splits.fingerprint(_assigned(spark, d), "k")


# Set scores: truth = returned parts of an order, prediction = parts bought in quantity


def _sets(spark: SparkSession, d: str, where: str, least: float = 0.0) -> DataFrame:
    """(qid, ids) of every order; orders without such parts have an empty array."""
    keep = F.when(F.expr(where), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("qid")).agg(F.array_sort(F.collect_set(keep)).alias("ids"))


_TRUTH, _PRED, _CAND = "l_returnflag = 'R'", "l_quantity > 25", "l_quantity > 10"
_COUNTS = f"""pairs AS (SELECT l_orderkey AS q, l_partkey AS p, bool_or({_TRUTH}) AS t, bool_or({_PRED}) AS r, bool_or({_CAND}) AS c FROM lineitem GROUP BY ALL),
  n AS (SELECT q, count(*) FILTER (t) AS nt, count(*) FILTER (r) AS nr, count(*) FILTER (t AND r) AS tp, count(*) FILTER (t AND c) AS tc FROM pairs GROUP BY 1),
  f AS (SELECT *, CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nt = 0 OR nr = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (nt - tp) + (nr - tp)) END AS score,
    CASE WHEN nt = 0 THEN 1.0 WHEN tc = 0 THEN 0.0 ELSE 1.25 * tc / (1.25 * tc + 0.25 * (nt - tc)) END AS best FROM n)"""


@query(f"WITH {_COUNTS} SELECT CAST(q AS VARCHAR) AS qid, round(score, 6) AS score FROM f")
def fbeta_per_query(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.score_queries(_sets(spark, d, _TRUTH), _sets(spark, d, _PRED), strict=False)
    return scored.select("qid", F.round("score", 6).alias("score"))


@query(f"WITH {_COUNTS} SELECT round(avg(score), 6) AS macro_f05, count(*) AS n_queries FROM f")
def macro_fbeta(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.score_queries(_sets(spark, d, _TRUTH), _sets(spark, d, _PRED), strict=False)
    return scored.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("macro_f05"), F.count("*").alias("n_queries"))


@query(f"WITH {_COUNTS} SELECT round(sum(tc) / sum(nt), 6) AS micro_recall, round(avg(tc / nt), 6) AS macro_recall, count(*) AS n_queries FROM n WHERE nt > 0")
def candidate_recall(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.candidate_recall(_sets(spark, d, _TRUTH), _sets(spark, d, _CAND))
    return out.select(F.round("micro_recall", 6).alias("micro_recall"), F.round("macro_recall", 6).alias("macro_recall"), "n_queries")


@query(f"WITH {_COUNTS} SELECT round(avg(CASE WHEN tc = nt THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM n WHERE nt > 0")
def complete_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.complete_coverage(_sets(spark, d, _TRUTH), _sets(spark, d, _CAND)).select(F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_COUNTS} SELECT round(avg(best), 6) AS oracle_f05 FROM f")
def oracle_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_mean(metrics.oracle_scores(_sets(spark, d, _TRUTH), _sets(spark, d, _CAND)), "oracle_f05").select(F.round("oracle_f05", 6).alias("oracle_f05"))


_THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]


@query(f"""WITH p AS (SELECT l_orderkey AS q, l_partkey AS p, bool_or({_TRUTH}) AS t, max(l_quantity / 50.0) AS s FROM lineitem GROUP BY ALL),
  g AS (SELECT q, x AS threshold, count(*) FILTER (t) AS nt, count(*) FILTER (s >= x) AS nr, count(*) FILTER (t AND s >= x) AS tp FROM p, (SELECT unnest({_THRESHOLDS}) AS x) GROUP BY ALL)
  SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN nt = 0 AND nr = 0 THEN 1.0 WHEN nt = 0 OR nr = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (nt - tp) + (nr - tp)) END), 6) AS macro_f05 FROM g GROUP BY 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("qid"), F.col("l_partkey").alias("id")).agg(F.max(F.col("l_quantity") / 50.0).alias("score"))
    return retrieve.threshold_sweep(pairs, _sets(spark, d, _TRUTH), _THRESHOLDS).select("threshold", F.round("macro_f05", 6).alias("macro_f05"))


@query(f"""WITH {_COUNTS} SELECT CASE WHEN t AND r THEN 'matched' WHEN t AND c THEN 'rejected' WHEN t THEN 'unretrieved' WHEN r THEN 'wrongly_accepted' ELSE 'correctly_rejected' END AS fate, count(*) AS n
  FROM pairs WHERE t OR c OR r GROUP BY 1""")
def error_budget(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda where: table(spark, d, "lineitem").where(where).select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id"))
    return retrieve.error_budget(pick(_TRUTH), pick(_CAND), pick(_PRED))


@query(f"""WITH {_COUNTS}, s AS (SELECT q, best - score AS delta FROM (SELECT q, score,
    CASE WHEN nt = 0 AND nc = 0 THEN 1.0 WHEN nt = 0 OR nc = 0 THEN 0.0 ELSE 1.25 * tc / (1.25 * tc + 0.25 * (nt - tc) + (nc - tc)) END AS best
    FROM f JOIN (SELECT q, count(*) FILTER (c) AS nc FROM pairs GROUP BY 1) USING (q))),
  u AS (SELECT replicate, delta, CAST(CAST('0x' || substr(sha256('42:' || q || ':' || replicate), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM s, (SELECT unnest(range(0, 50)) AS replicate)),
  w AS (SELECT replicate, delta, CAST(u >= 0.36787944117144233 AS INTEGER) + CAST(u >= 0.7357588823428847 AS INTEGER) + CAST(u >= 0.9196986029286058 AS INTEGER) + CAST(u >= 0.9810118431238462 AS INTEGER)
    + CAST(u >= 0.9963401531726563 AS INTEGER) + CAST(u >= 0.9994058151824183 AS INTEGER) + CAST(u >= 0.9999167588507119 AS INTEGER) + CAST(u >= 0.9999897508033253 AS INTEGER) AS w FROM u)
  SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(w * delta) / sum(w), 6) AS mean_delta FROM w GROUP BY 1""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.score_queries(_sets(spark, d, _TRUTH), _sets(spark, d, _PRED), strict=False).select("qid", F.col("score").alias("a"))
    b = metrics.score_queries(_sets(spark, d, _TRUTH), _sets(spark, d, _CAND), strict=False).select("qid", F.col("score").alias("b"))
    means = retrieve.paired_bootstrap(a.join(b, "qid").withColumn("delta", F.col("b") - F.col("a")), "qid", "delta", 50)
    return means.select("replicate", F.round("mean_delta", 6).alias("mean_delta"))


# Validation, samples, references


def _list_rows(spark: SparkSession, d: str, where: str) -> DataFrame:
    rows = _truth_rows(spark, d) if where == "all" else None
    if rows is None:
        ids = table(spark, d, "lineitem").where(where).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("S2-"), F.col("l_partkey").cast("string")))), ",").alias("matched_entity_ids"))
        rows = ids.select(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("source1_entity_id"), F.col("l_orderkey").alias("row_id"), "matched_entity_ids")
    return rows.select(F.col("source1_entity_id").alias("s1_id"), truth.split_ids(F.col("matched_entity_ids"), trim=False).alias("ids"), F.col("row_id").alias("line_number"))


@query(f"""WITH {_STATUSES}, q AS (SELECT l_orderkey, id FROM e), v AS (SELECT DISTINCT 'S2-' || (p_partkey % 5) AS id FROM part UNION SELECT DISTINCT 'S3-' || (p_partkey % 6) FROM part),
  d AS (SELECT l_orderkey, id, CASE WHEN id LIKE 'S1-%' THEN 'self_match' WHEN id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%' THEN 'wrong_prefix' WHEN id NOT IN (SELECT id FROM v) THEN 'unknown_id' END AS rule FROM q)
  SELECT rule, count(*) AS n FROM d WHERE rule IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'duplicate_id_in_list', count(*) FROM (SELECT l_orderkey FROM q GROUP BY 1 HAVING count(*) <> count(DISTINCT id)) HAVING count(*) > 0
  UNION ALL SELECT 'missing_required', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM q) HAVING count(*) > 0
  UNION ALL SELECT 'extra_row', count(DISTINCT l_orderkey) FROM q WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0""")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    valid = part.select(F.concat(F.lit("S2-"), (F.col("p_partkey") % 5).cast("string")).alias("id")).unionByName(part.select(F.concat(F.lit("S3-"), (F.col("p_partkey") % 6).cast("string")).alias("id"))).distinct()
    required = table(spark, d, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("id"))
    return validate.list_violations(_list_rows(spark, d, "all"), "matching", required, valid).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""SELECT 'S1-' || l_orderkey || ':S2-' || l_partkey AS offender FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE {_TRUTH}
  EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE {_CAND})""")
def subset_lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = _list_rows(spark, d, _TRUTH).withColumn("ids", F.array_distinct("ids"))
    return validate.subset_violations(rows, _list_rows(spark, d, _CAND)).select("offender")


@query("""WITH c AS (SELECT c_custkey FROM customer ORDER BY substr(sha256('42:' || c_custkey), 1, 16), c_custkey LIMIT 50)
  SELECT c_custkey, count(o_orderkey) AS n_orders FROM c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def linked_sample(spark: SparkSession, d: str) -> DataFrame:
    picked = sample.sample_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50, strict=False)
    return picked.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    return sample.missing_references(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 25"), "l_partkey", "p_partkey")


# Variation labels


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("business_name"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand").alias("business_address"), F.col("p_type").alias("country"))


def _labelled(spark: SparkSession, d: str, reading: variation.Reading = variation.FOLDED) -> DataFrame:
    """Turns of a conversation against the turn before: names are the texts, addresses the roles."""
    number = F.col("turn").cast("string")
    address = F.concat_ws(", ", "role", number) if reading.filled else F.concat("role", F.lit(", "), number)
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("business_name"), address.alias("business_address"), F.lit("US").alias("country"))
    after = variation.prepared(turns, "b", ("conv_id", "turn"), reading)
    before = variation.prepared(turns.withColumn("turn", F.col("turn") + 1), "a", ("conv_id", "turn"), reading)
    return variation.label_pairs(before.join(after, ["conv_id", "turn"]))


@query()
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("conv_id", "turn", F.array_join("labels", ";").alias("labels"), "name_token_jaccard", "address_token_jaccard")


@query()
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return variation.label_counts(_labelled(spark, d), "conv_id")


_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}]+')"


@query(rf"""WITH t AS (SELECT conv_id, turn, {_TOK.format(c="text")} AS w FROM conversations), p AS (SELECT b.conv_id, b.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)
  SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS jaccard,
    list_sort(x) = list_sort(y) AS same_multiset, array_to_string(x, '') = array_to_string(y, '') AS same_letters FROM p""")
def turn_relations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", X.words_with_marks(F.lower("text")).alias("y"))
    p = t.join(t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("y").alias("x")), ["conv_id", "turn"])
    x, y = F.col("x"), F.col("y")
    return p.select("conv_id", "turn", F.round(A.jaccard(x, y), 6).alias("jaccard"), A.same_multiset(x, y).alias("same_multiset"), (F.array_join(x, "") == F.array_join(y, "")).alias("same_letters"))


@query("""WITH a AS (SELECT p_name, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS b FROM part GROUP BY 1)
  SELECT p_partkey, k AS anchor_key, p_brand, b AS anchor_brand FROM part JOIN a USING (p_name) WHERE p_partkey <> k AND p_brand <> b""")
def collisions(spark: SparkSession, d: str) -> DataFrame:
    found = variation.collisions(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name"], "p_brand", "p_partkey")
    return found.select("p_partkey", F.col("anchor.p_partkey").alias("anchor_key"), "p_brand", F.col("anchor.p_brand").alias("anchor_brand"))


@query()
def greedy_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).groupBy(F.col("conv_id").cast("string").alias("entity_id")).agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    rows = truth.checkpointed(rows)
    chosen = sample.greedy_coverage(rows, 20)
    return rows.where(F.col("entity_id").isin(*chosen)).select("entity_id", F.array_join(F.array_sort("labels"), ";").alias("labels"))


@query("""SELECT count(*) AS n, count_if(l_discount > 0.05) AS discounted, count_if(l_returnflag = 'R' AND l_linestatus = 'F') AS returned, count_if(l_quantity >= 45) AS large,
  count_if(l_tax = 0) AS untaxed, count_if(l_extendedprice > 50000) AS dear FROM lineitem""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rules = {"discounted": "l_discount > 0.05", "returned": "l_returnflag = 'R' AND l_linestatus = 'F'", "large": "l_quantity >= 45", "untaxed": "l_tax = 0", "dear": "l_extendedprice > 50000"}
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), *[F.count_if(F.expr(r)).alias(n) for n, r in rules.items()])


# Retrieval: benchmark items ask, documents answer

#: Candidates of a route and of the budget.
ROUTE_K, BUDGET_K = 30, 10
_WORDS = r"[\p{L}\p{N}]+"


def _routes(spark: SparkSession, d: str) -> list[DataFrame]:
    """Two routes in which every token counts, over the counted number of documents."""
    ask = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), X.words(F.lower("text")).alias("w"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.words(F.lower("text")).alias("w"))
    n_docs = docs.count()
    out = []
    for name, least in (("words", 1), ("long_words", 9)):
        keep = lambda w, least=least: F.filter(w, lambda t: F.length(t) >= least)
        index = retrieve.postings(docs, "id", keep(F.col("w")))
        out.append(retrieve.route(retrieve.postings(ask, "qid", keep(F.col("w"))), index, n_docs, name, ROUTE_K, None))
    return out


def _route_sql(name: str, least: int) -> str:
    return rf"""q_{name} AS (SELECT DISTINCT item_id AS qid, token FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS token FROM benchmark) WHERE length(token) >= {least}),
  i_{name} AS (SELECT DISTINCT doc_id AS id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS token FROM documents) WHERE length(token) >= {least}),
  d_{name} AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) AS idf FROM i_{name} GROUP BY 1),
  s_{name} AS (SELECT qid, id, round(sum(idf), 9) AS s FROM q_{name} JOIN d_{name} USING (token) JOIN i_{name} USING (token) GROUP BY ALL),
  r_{name} AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s_{name} QUALIFY r <= {ROUTE_K})"""


@query(f"WITH {_route_sql('words', 1)} SELECT qid, id, CAST(r AS INTEGER) AS route_rank, round(s, 6) AS route_score FROM r_words")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d)[0].select("qid", "id", "route_rank", F.round("route_score", 6).alias("route_score"))


_RRF = f"""WITH {_route_sql('words', 1)}, {_route_sql('long_words', 9)},
  u AS (SELECT qid, id, sum(1.0 / (60 + r)) AS rrf FROM (SELECT qid, id, r FROM r_words UNION ALL SELECT qid, id, r FROM r_long_words) GROUP BY ALL),
  b AS (SELECT qid, id, rrf, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, id) AS k FROM u QUALIFY k <= {BUDGET_K})"""


@query(f"{_RRF} SELECT qid, id, CAST(k AS INTEGER) AS final_candidate_rank, round(rrf, 6) AS rrf FROM b")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.budget(retrieve.fuse(_routes(spark, d)), BUDGET_K).select("qid", "id", "final_candidate_rank", F.round("rrf", 6).alias("rrf"))


@query(f"""{_RRF}, n AS (SELECT item_id AS qid, count(id) AS c FROM benchmark LEFT JOIN b ON qid = item_id GROUP BY 1)
  SELECT count(*) AS n_queries, avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END) AS zero_hit_rate, avg(c) AS mean_candidates, quantile_cont(c, 0.95) AS p95, quantile_cont(c, 0.99) AS p99, max(c) AS max_candidates FROM n""")
def candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.budget(retrieve.fuse(_routes(spark, d)), BUDGET_K).select("qid", "id")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    counts = retrieve.with_manifest(asked, found).groupBy("qid").agg(F.count("id").alias("n_candidates"))
    return retrieve.retrieval_report(counts)


@query(f"{_RRF} SELECT qid, id, CAST(k AS INTEGER) AS final_candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY k, id) AS j FROM b WHERE id % 40 <> qid AND qid % 5 <> 0) WHERE j <= 5")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.budget(retrieve.fuse(_routes(spark, d)), BUDGET_K).select("qid", "id", "final_candidate_rank")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"))
    pairs = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("id"))
    return retrieve.hard_negatives(found, pairs, asked.where("qid % 5 = 0"), 5)


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL),
  s AS (SELECT label, vec_id, round(sum(CAST(v AS DOUBLE) * m) / sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / sqrt(sum(m * m)), 6) AS cosine FROM x JOIN c USING (label, i) GROUP BY ALL)
  SELECT label, vec_id, cosine, CAST(row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    c = x.groupBy("label", "i").agg(F.avg("v").alias("m"))
    dot = F.sum(F.col("v") * F.col("m")) / F.sqrt(F.sum(F.col("v") * F.col("v"))) / F.sqrt(F.sum(F.col("m") * F.col("m")))
    s = x.join(c, ["label", "i"]).groupBy("label", "vec_id").agg(F.round(dot, 6).alias("cosine"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cosine"), "vec_id"))).where("rank <= 5")


# Streams


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    truth.checkpointed(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/kinloom-{uuid.uuid4().hex}"


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return incremental.run_available(incremental.first_seen(incremental.parquet_stream(spark, f"{d}/events.parquet").select("user_id"), "user_id"), scratch(spark))


@query("SELECT doc_id, strlen(text) = length(text) AS ascii FROM documents")
def ascii_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", U.is_ascii(F.col("text")).alias("ascii"))
