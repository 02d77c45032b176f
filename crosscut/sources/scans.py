"""Scans of change sets, snapshots and repository trees, with their limits as relational operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .staging import running

PR_FILES = "pr_id BIGINT, file_ord INT, filename STRING, patch STRING"
SNAPSHOTS = "file_ord INT, filename STRING, content STRING"
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

# Limits.
WEBHOOK_FILES, API_FILES, API_CONTENT_FILES = 50, 100, 20
MAX_CONTENT_BYTES, MAX_TREE_BYTES, MAX_FILES, MAX_TOTAL_CHARS = 50 * 1024, 100 * 1024, 200, 10 * 1024 * 1024


def pr_files(files: DataFrame, limit: int = WEBHOOK_FILES, by: tuple[str, ...] = ("pr_id",)) -> DataFrame:
    """The first limit files of each change set."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("file_ord"))
    return files.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def decoded_content(files: DataFrame, limit: int = MAX_CONTENT_BYTES) -> DataFrame:
    """content of rows (kind, size, encoded): base64 text of files within the limit; null for others, and for empty ones."""
    ok = (F.col("kind") == "file") & (F.col("size") <= limit)
    body = F.decode(F.unbase64(F.regexp_replace("encoded", r"\s", "")), "UTF-8")
    return files.withColumn("content", F.when(ok & (F.octet_length(body) <= limit) & (body != ""), body))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, size) of the text files under a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.col("path").alias("filename"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def tree_filter(files: DataFrame, path_col: str = "filename", size_col: str = "size") -> DataFrame:
    """Files of a tree that a baseline scan reads: code, no tests, nothing vendored, not too large; a null size passes."""
    p = F.col(path_col)
    return files.where(X.is_code_file(p) & ~X.any_of(p, X.BASELINE_SKIPS) & (F.col(size_col).isNull() | (F.col(size_col) <= MAX_TREE_BYTES)))


def bounded(files: DataFrame, max_files: int = MAX_FILES, max_chars: int = MAX_TOTAL_CHARS, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """The first max_files of each repository by path, up to the one with which their text exceeds max_chars.

    A path is there once a repository. Only paths and lengths are ordered; contents are joined to the files that are kept.
    """
    keys = running(files.select(*by, "filename", F.length("content").cast("long").alias("size_")), by, ("filename",), "size_")
    kept = keys.where((F.col("rows_before") < max_files) & (F.col("sum_before") <= max_chars)).select(*[F.col(b).alias(f"{b}_in") for b in by], F.col("filename").alias("filename_in"))
    same = F.col("filename") == F.col("filename_in")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_in"))
    return files.join(kept, same, "left_semi")


def checked_requests(requests: DataFrame) -> DataFrame:
    """Adds error to API requests (owner, repo, pull_number); null for valid ones."""
    bad = lambda c: F.col(c).isNull() | (F.col(c) == "")
    error = F.when(bad("owner"), "owner is required").when(bad("repo"), "repo is required").when(F.col("pull_number").isNull() | (F.col("pull_number") <= 0), "pull_number must be positive")
    return requests.withColumn("error", error)


def with_installation(requests: DataFrame, installations: DataFrame) -> DataFrame:
    """Adds installation_id, and an error to requests whose repository has none."""
    x = requests.join(installations.select("owner", "repo", "installation_id"), ["owner", "repo"], "left")
    return x.withColumn("error", F.coalesce("error", F.when(F.col("installation_id").isNull(), "not installed")))


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Hook events from Parquet files, as a table or as a stream of new files."""
    return (spark.readStream.schema(EVENTS) if stream else spark.read.schema(EVENTS)).parquet(path)
