"""Sinks for micro-batches that may come again: plan state merged by installation, reports routed to a table each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import tier

PLANS = "installation_id long, tier string, ts timestamp, event_id long"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches of which path has a complete version, in order."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("batch=")]
    return sorted(int(n.getName()[6:]) for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def plan_table(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The newest complete version of the plan table, or the newest below a batch; empty if there is none."""
    known = [v for v in versions(spark, path) if below is None or v < below]
    return spark.read.schema(PLANS).parquet(f"{path}/batch={known[-1]}") if known else spark.createDataFrame([], PLANS)


def merge_plans(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over hook events: each batch makes the table's next version from the one before it.

    A batch that comes again is merged with the same earlier version and replaces its own, so nothing counts twice; cancelled installations stay as
    rows without a tier, so that an older event that comes late does not bring them back. The table has a row an installation and is
    written anew by each batch that changes it; versions older than the newest keep are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = batch.where("event = 'marketplace_purchase' and purchase in ('purchased', 'changed', 'cancelled') and installation_id is not null")
        told = told.select("installation_id", F.when(F.col("purchase") != "cancelled", tier(F.col("plan_name"))).alias("tier"), "ts", "event_id")
        both = plan_table(spark, path, batch_id).unionByName(told)
        last = both.groupBy("installation_id").agg(F.max(F.struct("ts", "event_id", "tier")).alias("m")).select("installation_id", "m.tier", "m.ts", "m.event_id")
        last.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for old in [v for v in versions(spark, path) if v <= batch_id][:-keep]:
            fs, p = _files(spark, f"{path}/batch={old}")
            fs.delete(p, True)

    return merge


def current_plans(spark: SparkSession, path: str) -> DataFrame:
    """(installation_id, tier) of installations that have a plan."""
    return plan_table(spark, path).where("tier is not null").select("installation_id", "tier")


def deliver(sinks: Mapping[str, str], route: Callable[[DataFrame], DataFrame], failed: str, valid: Column | None = None, name: str = "delivery_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of each route (a column that route adds) to its sink, rows that are not valid, or have no sink, to failed.

    A micro-batch is read once and fanned out. Each sink gets a folder a batch, which a batch that comes again replaces, and a delivery
    (name) once a batch; so after a failure between two sinks and a restart each report is there once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = route(batch).dropDuplicates([name])
        ok = (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))) & F.coalesce(F.col("route").isin(*sinks), F.lit(False))
        rows = rows.withColumn("delivered", ok).persist()
        try:
            for to, path in sinks.items():
                rows.where(F.col("delivered") & (F.col("route") == to)).drop("delivered").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            rows.where("not delivered").drop("delivered").write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
        finally:
            rows.unpersist()

    return run
