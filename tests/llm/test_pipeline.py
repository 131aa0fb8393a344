"""The stages of the pipeline: what goes, what stays, and the oracles of the two native queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinloom.llm import common
from kinloom.llm import queries as registered

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "123 456"), (None, "the and of")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert docs.where(F.col("text").isNull() | (F.col("text") == "")).isEmpty()
    assert docs.groupBy("text").count().where("count > 1").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    assert packed.where("piece = 0").count() == docs.count()
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_rows_with_one_id(spark):
    """A text that is linked with nothing stays, whatever else has its id; of each group one row stays, of rows without an id too."""
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    rows = [(1, t), (8, t), (8, u), (None, u), (None, v), (None, v + " end"), (9, u), (9, u), (7, None), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS again", "2 AS label")
    out = corpus_pipeline.join_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    left = sorted((str(r["doc_id"]), str(r["text"])[:3]) for r in out.collect())
    assert left == sorted([("1", "t0 "), ("8", "u0 "), ("None", "v0 "), ("7", "Non"), ("7", "Non"), ("7", "")])


def test_copies_beyond_a_broadcast(spark, monkeypatch):
    """With more copies than can be broadcast, only texts that may be copies are shuffled to be taken out, and the same ones go."""
    rows = [(k, " ".join(f"w{k % 80}-{i}" for i in range(12))) for k in range(100)] + [(None, "w5 alone")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    out = corpus_pipeline.join_near_duplicates(spark, docs, SF)
    assert "bitmap_construct_agg" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["doc_id"]), r["text"][:3]) for r in out.collect()) == sorted((str(k), t[:3]) for k, t in rows[:80] + rows[-1:])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(SF, 'documents.parquet')}')")
    cursor = con.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(tuple(str(v) for v in r) for r in cursor.fetchall())
    got = registered.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(tuple(str(v) for v in r) for r in got) == want


@pytest.mark.parametrize(("share", "collected"), [(0.0, True), (1.1, False)])
def test_shelf_keeps_the_heap_small(spark, monkeypatch, share, collected):
    """A table on a shelf is followed by a full collection if the driver's heap is in use beyond the share, and only then."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and b.getName() not in ("Copy", "PS Scavenge")]
    monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
    with common.Shelf(spark) as shelf:
        shelf.put(spark.range(1))
        before = sum(b.getCollectionCount() for b in beans)
        assert shelf.put(spark.range(10)).count() == 10
        assert (sum(b.getCollectionCount() for b in beans) > before) is collected
