"""How far sources of one language differ in the words they use: distances of smoothed frequencies, counted over supports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, checked
from .words import FOLD, raw, release, slices

#: Term bytes: letters, and all of non-ASCII characters.
TERM = np.zeros(256, dtype=bool)
TERM[65:91] = TERM[97:123] = True
TERM[128:] = True
#: Bytes of text that are counted at once.
SLICE = 8 << 20
UNIT = 1_000_000_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of texts that lie one after another in data, folded, and the number of each one's text."""
    ok = TERM[data]
    begins, finish = ok.copy(), ok.copy()
    begins[1:] &= ~ok[:-1]
    finish[:-1] &= ~ok[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges], finish[edges - 1] = ok[edges], ok[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(FOLD[data[ok]]))
    return text, np.searchsorted(bounds, starts, side="right") - 1


def _count(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts) of texts that lie one after another."""
    text, doc = _terms(data, bounds)
    coded = text.dictionary_encode()
    k = max(len(coded.dictionary), 1)
    # the terms of each text first, then those texts by group
    pair, n = np.unique(doc * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key, at = np.unique(group[pair // k] * k + pair % k, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    return key // k, coded.dictionary.take(pa.array(key % k)).cast(pa.string()), total, np.bincount(at, minlength=len(key)).astype(np.int64)


def _long(data: np.ndarray) -> pa.Table:
    """(term, n) of one text, piece by piece between terms, so that it needs room for its different terms only."""
    found, at = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and TERM[data[end]]:  # up to the end of a term
            more = np.flatnonzero(~TERM[data[end : end + SLICE]])
            end = end + int(more[0]) if len(more) else min(end + SLICE, len(data))
        _, term, n, _ = _count(data[at:end], np.array([0, end - at]), np.zeros(1, dtype=np.int64))
        both = pa.concat_tables([found, pa.table({"term": term, "n": pa.array(n)})])
        found, at = both.group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"]), end
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in (0, 1))
        width = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + source.indices.to_numpy(zero_copy_only=False)
        for lo, hi in slices(batch.column(2), SLICE):
            data, bounds = raw(batch.column(2).slice(lo, hi - lo))
            if hi - lo == 1 and len(data) > SLICE:
                whole = _long(data)
                term, n = whole["term"].combine_chunks(), whole["n"].to_numpy()
                g, d = np.full(len(n), group[lo]), np.ones(len(n), dtype=np.int64)
            else:
                g, term, n, d = _count(data, bounds, group[lo:hi])
            for a in range(0, len(g), 50_000):
                z = slice(a, a + 50_000)
                columns = [lang.dictionary.take(pa.array(g[z] // width)), source.dictionary.take(pa.array(g[z] % width)), term.slice(a, 50_000), pa.array(n[z]), pa.array(d[z])]
                yield pa.RecordBatch.from_arrays(columns, schema=COUNTS)
        release()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it); nulls are empty strings.

    Terms are maximal runs of letters and non-ASCII characters, A-Z lower-cased. Each task counts slices of its texts, Spark adds them up before and
    after its shuffle, so a term or a group that fills a third of all texts meets as one row a task.
    """
    x = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    found = x.mapInArrow(_counts, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact for any long; null without terms."""
    wide = lambda c: c.cast("decimal(25,0)")
    return 1 + F.call_function("div", wide(count + 5) * F.lit(UNIT).cast("decimal(10,0)"), F.nullif(wide(total) + wide(terms) * 5, F.lit(0)))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources of a language, and the terms that mark each source.

    Each language keeps the terms of at least min_docs of its documents. Part pair: the distance of the shares (see share) of
    all kept terms between a source and each other one of its language. Part term: the top terms whose share is above the
    language's, with the difference. rank goes by value, largest first, then item.

    Distances add up over supports, never over all terms of all pairs: a term that only one of two sources has costs |p - z|, z being
    the other's share of a term it lacks, and these sum over a histogram of the source's counts; both-zero terms cost one
    constant; the sparse join of postings by term corrects the terms that both have. What is joined grows with postings and with
    the pairs of sources that the result has.

    Nulls of any of the three columns count as empty strings, so a null source is the same group as an empty one. Groups without terms are
    there too, with shares of zero counts; in a language without kept terms all distances are 0. Repeated rows are documents
    like others. Other columns are not looked at, whatever their names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    by_term = Window.partitionBy("lang", "term")
    every = term_counts(docs, text, lang, source)
    # a term's rows are one for each source that has it
    every = every.withColumns({"lang_n": F.sum("n").over(by_term), "lang_d": F.sum("d").over(by_term), "lead": (F.row_number().over(by_term.orderBy("source")) == 1).cast("long")})
    kept = scratch.keep(every.where(F.col("lang_d") >= min_docs).select("lang", "source", "term", "n", "lang_n", "lead"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("v"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.count("*").alias("s"), F.sum("n").alias("total"))
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = scratch.keep(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    posted = kept.join(checked(groups), ["lang", "source"]).select(
        "lang", "source", "term", "z", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")
    )
    posted = scratch.keep(posted, "posted")

    a, b = F.col("source"), F.col("item")
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"), F.col("s").alias("sb"))
    both_ways = lambda x: x.unionByName(x.select("lang", b.alias("source"), a.alias("item"), "value"))
    # all terms as if neither had them, less those that one has
    constant = groups.join(checked(others), "lang").where(a != b).select("lang", "source", "item", ((F.col("v") - F.col("s") - F.col("sb")) * F.abs(F.col("z") - F.col("zb"))).alias("value"))
    bars = posted.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    one = bars.join(checked(others), "lang").where(a != b).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("zb"))).alias("value"))
    x, y = posted.select("lang", "term", "source", "p", "z"), posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    met = x.join(y, ["lang", "term"]).where(a < b).groupBy("lang", "source", "item")
    p, pb, z, zb = map(F.col, ("p", "pb", "z", "zb"))
    overlap = met.agg(F.sum(F.abs(p - pb) - F.abs(p - zb) - F.abs(z - pb) + F.abs(z - zb)).alias("value"))
    parts = [constant, both_ways(one), both_ways(overlap)]
    pair = reduce(DataFrame.unionByName, parts).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    term = posted.where("p > q").select("lang", "source", F.col("term").alias("item"), (p - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= top))
