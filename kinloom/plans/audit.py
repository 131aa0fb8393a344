"""The audit: labelled pairs of a linked sample, what each label covers, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import variation
from kinloom.sources.sinks import publish_parquet, write_json
from kinloom.sources.tsv import read_table


def pair_diagnostics(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: labelled pairs and how many agree in name, in address, in both, in neither, differ in country, and are unchanged."""
    same = lambda f: F.col(f"{a}_{f}") == F.col(f"{b}_{f}")
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(same("name")).alias("same_name"), F.count_if(same("address")).alias("same_address"), F.count_if(same("name") & same("address")).alias("same_both"),
        F.count_if(~same("name") & ~same("address")).alias("same_neither"), F.count_if(~same("country")).alias("other_country"), F.count_if(F.array_contains("labels", "unchanged_record")).alias("unchanged"),
    )


def label_coverage(counts: DataFrame, known: list[str], chosen: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(label, pairs, entities, selected, covered) of every known label, zeros included: `chosen` has the selected entities with their labels."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(x,) for x in known], "label string")
    picked = chosen.select(entity, F.explode("labels").alias("label")).groupBy("label").agg(F.count_distinct(entity).alias("selected"))
    full = every.join(counts, "label", "left").join(picked, "label", "left").na.fill(0)
    return full.select("label", "pairs", "entities", "selected", (F.col("selected") > 0).alias("covered"))


def audit(spark: SparkSession, labelled: DataFrame, records: DataFrame, out: str, known: list[str], size: int, entity: str = "entity_id") -> dict:
    """Writes pairs, label counts, coverage, first examples and same-name records below `out`, and `audit_summary.json`, which is returned."""
    from kinloom.operators.sample import greedy_coverage

    publish_parquet(labelled, f"{out}/variation_pairs")
    pairs = read_table(spark, f"{out}/variation_pairs")
    publish_parquet(variation.label_counts(pairs, entity), f"{out}/variation_counts")
    of_entity = pairs.groupBy(entity).agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    picked = spark.createDataFrame([(x,) for x in greedy_coverage(of_entity.withColumn(entity, F.col(entity).cast("string")), size, key=entity)], f"{entity} string")
    chosen = of_entity.withColumn(entity, F.col(entity).cast("string")).join(F.broadcast(picked), entity)  # `size` rows
    coverage = label_coverage(read_table(spark, f"{out}/variation_counts"), known, chosen, entity)
    publish_parquet(coverage, f"{out}/variation_categories")
    publish_parquet(variation.first_examples(pairs, entity).select("label", F.to_json("example").alias("example")), f"{out}/category_examples")
    publish_parquet(variation.collisions(records, ["business_name"], "business_address", "entity_id"), f"{out}/same_name_different_entities")
    rows = read_table(spark, f"{out}/variation_categories").collect()  # one for each known label
    summary = {
        "pairs": pairs.count(), "diagnostics": pair_diagnostics(pairs).first().asDict(), "selected": picked.count(),
        "covered": sorted(r["label"] for r in rows if r["covered"]), "uncovered": sorted(r["label"] for r in rows if not r["covered"]),
        "same_name_different_entities": read_table(spark, f"{out}/same_name_different_entities").count(),
    }
    write_json(spark, f"{out}/audit_summary.json", summary)
    return summary
