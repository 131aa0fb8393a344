"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree; at each level the children draw Exp(weight) variates from a hash of (row key, child)
and the smallest draw wins, so a child gets its share of the weight. Only a child whose weight grows can win
rows it did not have: movement stays inside the subtrees whose weights change.

Weights come in layers. The tree as first laid out is layer 0 and each later shard is a layer of its own along
its path. A draw is made per (child, layer) and a row stays within the layer that won, so a row won by the
new weight of an old rack goes to that rack's new shard and to no other: one more shard takes rows only into
itself, wherever it is placed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions


@dataclass(frozen=True)
class Leaf:
    """A shard: its place in the tree, its weight, and the layer in which it came."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    layer: int = 0


def even_tree(shards: int, racks: int = 3, per_rack: int = 4) -> tuple[Leaf, ...]:
    """Shards filled rack by rack and region by region, all of one weight, in layer 0."""
    return tuple(Leaf(s, s // (racks * per_rack), s // per_rack % racks) for s in range(shards))


def grow(tree: tuple[Leaf, ...], region: int = 0, rack: int = 0, weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard at the given place, as a layer of its own."""
    return (*tree, Leaf(len(tree), region, rack, weight, 1 + max(leaf.layer for leaf in tree)))


def draw(key: Column, label: str, weight: float) -> Column:
    """An Exp(weight) variate from 52 bits of a hash of the key and a label."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + label))), 1, 13), 16, 10).cast("long")
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(weight)


def _winner(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the smallest draw; ties go to the option listed first."""
    if len(options) == 1:
        return options[0][2]
    return F.array_min(F.array(*[F.struct(draw(key, label, weight).alias("d"), F.lit(k).alias("k"), value.alias("v")) for k, (label, weight, value) in enumerate(options)]))["v"]


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a row with this string key."""

    def level(leaves: list[Leaf], path: str, depth: int) -> Column:
        if depth == 3:
            return F.lit(leaves[0].shard)
        part = {}
        for leaf in leaves:
            child = (leaf.region, leaf.rack, leaf.shard)[depth]
            part.setdefault((child, leaf.layer), []).append(leaf)
        labels = {k: f"{path}{'rks'[depth]}{k[0]}.{k[1]}" for k in sorted(part)}
        if depth < 2:
            name = _winner(key, [(labels[k], sum(x.weight for x in part[k]), F.lit(labels[k])) for k in sorted(part)])
            chosen = F.lit(None).cast("int")
            for k in reversed(sorted(part)):
                chosen = F.when(name == labels[k], level(part[k], labels[k], depth + 1)).otherwise(chosen)
            return chosen if len(part) > 1 else level(part[next(iter(part))], labels[next(iter(part))], depth + 1)
        return _winner(key, [(labels[k], sum(x.weight for x in part[k]), F.lit(part[k][0].shard)) for k in sorted(part)])

    return level(list(tree), "", 0)


def row_key(column: str) -> Column:
    """The key of a row as a string; null has the key `null`."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def assign(rows: DataFrame, key: str, tree: tuple[Leaf, ...], then: tuple[Leaf, ...] | None = None) -> DataFrame:
    """Adds `shard`, and `grown_shard` under a second tree. The key alone decides; no row is moved."""
    k = row_key(key)
    out = rows.withColumn("shard", shard_of(k, tree).cast("int"))
    return out.withColumn("grown_shard", shard_of(k, then).cast("int") if then else F.lit(None).cast("int"))


def order_key(key: Column) -> Column:
    """A 60-bit hash by which the rows of a shard are put in order."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, 15), 16, 10).cast("long")


def slots(placed: DataFrame, group: str, order: str, ties: tuple[str, ...], column: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, by a 60-bit hash `order` and then `ties`.

    No group goes to one task: rows are numbered within ranges of the hash, and the numbers of the ranges
    before are added from a table of counts, one row for each group and range. Rows equal in all keys are
    numbered in any order.
    """
    spark = placed.sparkSession
    ranges = max(16, shuffle_partitions(spark))
    width = (1 << 60) // ranges + 1
    ranged = placed.withColumn("_range", F.expr(f"cast({order} div {width} as int)"))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(order, *ties)
    numbered = ranged.withColumn("_rank", F.row_number().over(within))
    return numbered.join(offsets, [group, "_range"]).withColumn(column, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_range", "_rank", "_before")


def shard_documents(docs: DataFrame, tree: tuple[Leaf, ...], then: tuple[Leaf, ...] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The size is the UTF-8 length plus 8, a null text counting as empty. Null ids share the key `null`; repeated
    rows go to one shard and get slots of their own. Other columns are not read. An empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = assign(narrow, "doc_id", tree, then).withColumn("_order", order_key(row_key("doc_id")))
    out = slots(placed, "shard", "_order", ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
