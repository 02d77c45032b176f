"""A corpus pipeline over documents: each stage applies one operator to all that the stage before kept.

Each function takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Columns
beside those of documents may have any name and stay as they are; the last stage's own replace those of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosscut.llm.decontaminate import remove_spans
from crosscut.llm.line_dedup import dedup_lines
from crosscut.llm.mixing import mix, text_size
from crosscut.llm.ngram_join import ngram_join
from crosscut.llm.quality import fit_quality, score
from crosscut.llm.shared import Aside, Scratch, checked


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules score under 0.5. The rules are fitted on the labelled ones among docs."""
    model = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    aside = Aside(docs)
    kept = score(aside.df, model, aside.df.columns, aside.name("text")).where("predicted = 1")
    return aside.back(kept.select(*aside.df.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier one repeats, however short, or nearly repeats. A document of which only blank lines are left goes."""
    aside = Aside(docs, ("n_chars",))
    out = dedup_lines(aside.df, aside.name("doc_id"), aside.name("text"))
    out = out.where((F.col("n_removed") == 0) | F.col(aside.name("text")).rlike(r"[^\x20\x09-\x0D]"))
    return aside.back(out.select(*aside.df.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group that links join.

    Rows without an id, and those that share one, are compared under numbers made from their content, above all
    ids; of rows with the same id and text, one stays.
    """
    scratch = Scratch(spark, "pipeline")
    aside = Aside(docs, ("doc_id", "text"))
    docs = aside.df
    again = scratch.keep(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")), "again")
    columns = docs.columns
    if again.limit(1).count():
        made = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
        known = docs.join(checked(again), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        plain = known.where("_again is null").select(F.col("doc_id").alias("_key"), *columns)
        docs = plain.unionByName(known.where("_again").select(made.alias("_key"), *columns).dropDuplicates(["_key"]))
    else:
        docs = docs.withColumn("_key", F.col("doc_id"))
    gone = scratch.keep(ngram_join(docs.select("_key", "text"), id_col="_key").where(~F.col("kept")).select("_key"), "gone")
    return aside.back(docs.join(checked(gone), "_key", "left_anti").select(*columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts spans that occur in benchmark items; documents that are mostly such spans go."""
    return remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each once, with how often it takes them and their source's size and target."""
    aside = Aside(docs, ("doc_id", "source", "text"))
    docs = aside.df
    took = mix(docs).where("copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "copies", "taken").distinct()
    sized = docs.withColumn("size", text_size(F.col("text")))
    out = sized.join(took, sized["doc_id"].eqNullSafe(took["_d"]) & sized["source"].eqNullSafe(took["_s"]) & (sized["size"] == took["_z"]))
    return aside.back(out.select(*docs.columns, "size", "source_size", "target", "copies", "taken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The classifier's fit and the rounding are not SQL; tests/llm/test_pipeline.py compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each one's rows written before the next reads them."""
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
