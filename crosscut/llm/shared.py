"""Intermediate tables, checked broadcasts and connected components for the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_ROOTS: dict[str, str] = {}
#: Most bytes of a table that are sent to every executor; above it Spark joins by shuffling.
MAX_BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="crosscut-")
    return _OWN_ROOTS[app]


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_live: weakref.WeakSet = weakref.WeakSet()


def release() -> None:
    """Frees the tables of all calls so far. For long sessions, when the results of these calls are written; else they go at the end."""
    for s in list(_live):
        s.end()


class Scratch:
    """Tables written by one call of an operator. Each cuts the lineage: a lost executor costs no more than the step since.

    They stay until the interpreter ends, or release() or end() is called, as a result may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_root(spark)}/crosscut-{name}-{uuid.uuid4().hex}", 0
        self.kept: list[str] = []
        _live.add(self)
        atexit.register(self.end)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and gives back the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.kept.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._crosscut_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that nothing unfinished still reads."""
        for t in tables:
            path = getattr(t, "_crosscut_path", None)
            if path in self.kept:
                drop_table(self.spark, path)
                self.kept.remove(path)

    def end(self) -> None:
        _live.discard(self)
        atexit.unregister(self.end)
        try:
            if self.spark.sparkContext._jsc is not None:
                drop_table(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Aside:
    """A table under names that no operator uses, but for the columns that stay, and the way back to its own."""

    def __init__(self, df: DataFrame, stay: tuple[str, ...] = ()):
        self._to = {c: c if c in stay else f"aside_{i}_" for i, c in enumerate(df.columns)}
        self._from = {v: k for k, v in self._to.items()}
        self.df = df.toDF(*self._to.values())

    def name(self, column: str) -> str:
        return self._to[column]

    def names(self, columns: list[str]) -> list[str]:
        return [self._to[c] for c in columns]

    def back(self, out: DataFrame) -> DataFrame:
        """out with the columns' own names. A column that the operator adds replaces one of the table with that name."""
        added = {c.lower() for c in out.columns if c not in self._from}
        out = out.drop(*[c for c in out.columns if self._from.get(c, "").lower() in added and c in self._from])
        return out.toDF(*[self._from.get(c, c) for c in out.columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system has path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def checked(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if it is small, in bytes. For written tables, of which measuring is cheap."""
    width = F.lit(16)
    for f in small.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            size = F.size(c) * 8
        elif isinstance(f.dataType, T.StringType | T.BinaryType):
            size = F.octet_length(c)
        else:
            size = F.lit(8)
        width = width + F.greatest(F.coalesce(size, F.lit(0)), F.lit(8))
    return F.broadcast(small) if (small.agg(F.sum(width)).first()[0] or 0) <= max_bytes else small


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a table of narrow rows has at most max_rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def components(edges: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node that has an edge.

    Alternates large-star and small-star steps; both keep each node's rows to min() aggregates that
    combine before the shuffle, and joins on the node, which Spark splits if one node is hot.
    """
    e = scratch.keep(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = scratch.keep(small.where("u <> v").distinct(), "small")
        # settled: every node points at one root, and no root points anywhere
        open_ = nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        several = open_ or nxt.groupBy("u").count().where("count > 1").limit(1).count()
        scratch.drop(e, large)
        e = nxt
        if not open_ and not several:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
