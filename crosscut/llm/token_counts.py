"""Token counts through a cache of counts by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch, checked, path_exists

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_loaded: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """Changes with the file and with the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    return f"{hashlib.sha256(Path(path).read_bytes()).hexdigest()}-{lib}"


def _counter(path: str):
    if path not in _loaded:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
    return _loaded[path]


def _encode(path: str, name: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if name is not None:
            import public_tokenizers

            where = public_tokenizers.path(name)
        count = _counter(where)
        for batch in batches:
            texts, n = batch.column("text"), []
            for a, b in W.slices(texts, 500_000):
                n += count(texts.slice(a, b - a).to_pylist())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, batch.column("digest"), batch.column("repeats"), pa.array(n, pa.int64())], names=["id", "n_bytes", "digest", "repeats", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: DataFrame | None = None, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and n_tokens of every row of docs.

    tokenizer is the name of a public tokenizer's file or a path that all executors have. The cache (a
    table of CACHE_SCHEMA, at cache_path) holds counts by SHA-256 of the content (null counts as empty)
    and tokenizer version; counts of the same content under another version are not used. Only
    contents that it lacks are encoded, each once, and appended at cache_path, which is made if there is
    none yet. Without a path, the cache is one of this call. Extra columns are left out; repeated rows are each reported.

    Texts stay where they are, unless contents that repeat are too many to send their digests to every
    executor. What repeats is encoded at the least id that has it, and the others join the count by digest; digests that
    occur once are not joined at all, so a content that very many rows share makes no large group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    if "/" in tokenizer:
        path, name = tokenizer, None
    else:
        import public_tokenizers

        path, name = public_tokenizers.path(tokenizer), tokenizer
    version = tokenizer_version(path)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = scratch.keep(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    contents = seen.groupBy("digest").agg(F.min(F.struct("id")).alias("first"), F.count("*").alias("n"))
    if cache is None and cache_path is not None and path_exists(spark, cache_path):
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    if cache is None:
        contents = contents.withColumn("known", F.lit(None).cast("long"))
    else:
        known = cache.where(F.col("version") == version).groupBy(F.col("digest").alias("_d")).agg(F.max("n_tokens").alias("known"))
        contents = contents.join(known, F.col("digest") == F.col("_d"), "left")
    # contents that a row has to know of: those that repeat and those that are counted already
    listed = contents.where("n > 1 or known is not null").select(F.col("digest").alias("_d"), F.col("first.id").alias("_first"), "known")
    listed = scratch.keep(listed, "listed")
    few = checked(listed)
    misses = rows.join(few, F.col("digest") == F.col("_d"), "left").where("_d is null or (known is null and id <=> _first)")
    misses = misses.select("id", "digest", F.col("_d").isNotNull().alias("repeats"), "text")
    encoded = scratch.keep(misses.mapInArrow(_encode(path, name), f"id {id_type}, n_bytes long, digest binary, repeats boolean, n_tokens long"), "encoded")
    once = encoded.where("not repeats").unionByName(encoded.where("repeats").dropDuplicates(["digest"]))
    once.withColumn("version", F.lit(version)).select("digest", "version", "n_tokens").write.mode("append").parquet(cache_path or f"{scratch.root}/cache")
    counts = listed.where("known is not null").select("_d", "known")
    counts = scratch.keep(counts.unionByName(encoded.where("repeats").groupBy(F.col("digest").alias("_d")).agg(F.max("n_tokens").alias("known"))), "counts")
    others = seen.join(few, F.col("digest") == F.col("_d")).where("known is not null or not (id <=> _first)").select("id", "n_bytes", "digest")
    others = others.join(checked(counts), F.col("digest") == F.col("_d")).select("id", "n_bytes", F.col("known").alias("n_tokens"))
    return encoded.select("id", "n_bytes", "n_tokens").unionByName(others).withColumnRenamed("id", id_col)
