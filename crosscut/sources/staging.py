"""Intermediate tables in the shared folder, for plans that read one step many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _roots.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="crosscut-stage-"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table: plans above it stay small, and a lost executor costs no more than the step since."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crosscut-stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """rows with rows_before and sum_before: how many rows of its group come before each, and the sum of their value (null is 0).

    A blocked scan: rows are ordered by ranges, so a group with most of the rows lies in many blocks; sums of blocks, a few for each group, give
    what is before a block, and windows within a block the rest. For narrow rows; what is wide is joined to those that are wanted. order
    should tell the rows of a group apart.
    """
    keys = [*by, *order]
    x = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("block", F.spark_partition_id()), "ordered")
    held = F.coalesce(F.col(value), F.lit(0))
    blocks = x.groupBy(*by, "block").agg(F.count("*").alias("n"), F.sum(held).alias("s"))
    above = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*[F.col(b).alias(f"{b}_of") for b in by], F.col("block").alias("block_of"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(above), F.lit(0)).alias("s0"))
    local = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"n1": F.count(F.lit(1)).over(local), "s1": F.coalesce(F.sum(held).over(local), F.lit(0))})
    same = F.col("block") == F.col("block_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_of"))
    x = x.join(starts, same)
    return x.select(*rows.columns, (F.col("n0") + F.col("n1")).alias("rows_before"), (F.col("s0") + F.col("s1")).alias("sum_before"))


@atexit.register
def release() -> None:
    """Deletes all staged tables. Results that still read them are lost, so this is for the end of a session, or when they are written."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
