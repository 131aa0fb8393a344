"""Id lists to match edges, with the offences of each list entry; owners and families."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.sources.tsv import target_source


def split_ids(c: Column, trim: bool = True) -> Column:
    """The elements of a comma list; truth trims them and drops empty ones, validators take them as they are."""
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "") if trim else F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, and `n_rows` of the key."""
    w = Window.partitionBy(key)
    return rows.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("n_rows", F.count("*").over(w)).where("_k = 1").drop("_k")


def parse_entries(truth: DataFrame, s1: str = "source1_entity_id", ids: str = "matched_entity_ids", order: str = "row_id") -> DataFrame:
    """s1_id, place, target_id, target_source, status for each list entry of each id's first row.

    status is ok, self_match, bad_prefix or duplicate, tested in this order. Repeated rows of an id are reported
    by `repeated_rows`.
    """
    once = first_rows(truth, s1, order)
    entries = once.select(F.col(s1).alias("s1_id"), F.posexplode(split_ids(F.col(ids))).alias("place", "target_id")).withColumn("target_source", target_source(F.col("target_id")))
    kind = F.when(F.startswith("target_id", F.lit("S1-")), "self_match").when(F.col("target_source").isNull(), "bad_prefix")
    nth = F.row_number().over(Window.partitionBy("s1_id", "target_id").orderBy("place"))
    return entries.withColumn("status", F.coalesce(kind, F.when(nth > 1, "duplicate"), F.lit("ok")))


def edges(entries: DataFrame) -> DataFrame:
    return entries.where("status = 'ok'").select("s1_id", "target_id", "target_source")


def repeated_rows(truth: DataFrame, s1: str = "source1_entity_id") -> DataFrame:
    return truth.groupBy(F.col(s1).alias("s1_id")).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def truth_sets(truth: DataFrame, s1: str = "source1_entity_id", ids: str = "matched_entity_ids", order: str = "row_id") -> DataFrame:
    """(qid, ids) with the sorted ok targets; an id without any keeps an empty array."""
    found = edges(parse_entries(truth, s1, ids, order)).groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias("ids"))
    return truth.select(F.col(s1).alias("s1_id")).distinct().join(found, "s1_id", "left").select(F.col("s1_id").alias("qid"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def owners(match_edges: DataFrame, target: str = "target_id") -> DataFrame:
    return match_edges.groupBy(target).agg(F.count("*").alias("n_owners"))


def multi_owner_targets(match_edges: DataFrame, target: str = "target_id") -> DataFrame:
    return owners(match_edges, target).where("n_owners > 1")


#: Parts into which the rows of one key are dealt where a key may have a large share of them.
SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many JOIN one on `key`, where `one` has a row for each key: a key's rows are dealt by a hash of `by`, and `one` is repeated for each part.

    `one` is never broadcast: repeated, it is far larger than the files by which Spark would judge it.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return left.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), [key, "_salt"], how).drop("_salt")


def families(nodes: DataFrame, match_edges: DataFrame, node: str = "s1_id", target: str = "target_id") -> DataFrame:
    """(node, family_id): nodes that share targets, directly or through others; the family is named by its smallest node.

    Nodes are tied to the smallest node of each of their targets, a star and no clique. Without a shared target
    no round is run. Each round takes smaller labels over the star edges and then the label's own label; rounds
    are written as tables to the checkpoint folder. A checkpoint would keep the size that Spark guesses for its plan: that of a
    join is the product of its sides, its digits would multiply from round to round and fill the driver.
    """
    every = nodes.select(F.col(node).alias("node")).distinct()
    lowest = match_edges.groupBy(target).agg(F.min(node).alias("low"))
    ties = salted_join(match_edges, lowest, target, node).where(F.col(node) != F.col("low")).select(F.col(node).alias("u"), F.col("low").alias("v")).distinct()
    top = f"{shared_folder(nodes)}/families-{uuid.uuid4().hex}"
    ties = stored(ties, f"{top}/ties")
    if ties.isEmpty():
        return every.select("node", F.col("node").alias("family_id"))
    both = stored(ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{top}/both")
    labels, turn = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), f"{top}/labels"), 0
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("v"), "label"), "v", "u").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = stored(salted_join(lower, jump, "label", "node").select("node", "was", F.least("label", "further").alias("label")), f"{top}/{turn}")
        labels, turn = lower.select("node", "label"), turn + 1
        if lower.where("was <> label").isEmpty():
            break
        if turn > 1:
            removed(nodes, f"{top}/{turn - 2}")
    for name in ("ties", "both", "labels"):
        removed(nodes, f"{top}/{name}")
    return every.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("label", "node").alias("family_id"))


def family_countries(family: DataFrame, records: DataFrame, node: str = "entity_id", country: str = "country", order: str = "row_id") -> DataFrame:
    """(family_id, country, n_nodes): a family has the country of its first member in row order; members without a record or a country have an empty one."""
    rows = family.join(records.groupBy(F.col(node).alias("node")).agg(F.min_by(F.struct(F.col(country).alias("c"), F.col(order).alias("o")), order).alias("at")), "node", "left")
    return rows.groupBy("family_id").agg(F.min_by(F.coalesce("at.c", F.lit("")), F.struct(F.col("at.o").isNull(), F.col("at.o"), F.col("node"))).alias("country"), F.count("*").alias("n_nodes"))


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kinloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, at: str) -> DataFrame:
    """The rows written to a table and read again: lineage is cut, and the size is that of the files."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(df: DataFrame, at: str) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
