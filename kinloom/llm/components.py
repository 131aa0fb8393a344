"""Joins and connected components that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, shuffle_partitions


def salts(df: DataFrame) -> int:
    """Parts into which the rows of a key are dealt; follows the number of partitions."""
    return max(8, shuffle_partitions(df.sparkSession) // 8)


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many JOIN one on `key`, where `one` has a row for each key: the rows of a key are dealt by a hash of `by`, and `one` is repeated for each part."""
    n = salts(many)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def shortcuts(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an undirected edge list: where three steps to the smallest neighbour, if that is smaller, lead.

    A node and its label are connected; connected nodes may have several labels. Null ends and loops are left out.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
    step = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label"))
    out = step
    for _ in range(2):
        out = out.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select("node", F.col("further").alias("label"))
    return out


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct edges (a, b), a < b, between the labels of the ends; nodes without a label are their own."""
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), "label")
        edges = salted_join(edges, named, end, "b" if end == "a" else "a", "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(shelf: Shelf, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an undirected edge list: the smallest node that it is connected with; on the shelf.

    In each round nodes are contracted to what their shortcuts lead to, which is smaller than any node that it
    takes in, until no edge is left. Only nodes that are the smallest among their neighbours survive a round, so their
    number halves at least. Null ends and loops are left out; no edges give no rows. Nothing is collected.
    """
    left = shelf.put(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        step = shelf.put(shortcuts(left))
        if found is None:
            found = step
        else:
            further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = shelf.put(salted_join(found, further, "label", "node", "left").select("node", F.coalesce("further", "label").alias("label")))
        left = shelf.put(relabelled(left, step))
        if left.isEmpty():
            return found
