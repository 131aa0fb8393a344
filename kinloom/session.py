"""Session defaults shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that hold at every scale; sizes that depend on a cluster are left to the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "kinloom", **conf: str) -> SparkSession:
    """A session with the defaults; `conf` overrides them (double underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("KINLOOM_LOG", "ERROR"))
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Spark send this package to every Python worker, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_kinloom_sent", False):
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="kinloom-"), f"{top.name}.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(at)
    sc._kinloom_sent = True


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, by any path Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
