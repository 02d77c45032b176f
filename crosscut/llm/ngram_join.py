"""Jaccard join of documents on word n-grams: MinHash bands for candidates, whole n-gram sets for the decision."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch, components

#: Documents of one side of a block of pairs.
BLOCK = 256
_C = np.uint64(0x9FB21C651E98DF25)


def choose_bands(threshold: float, recall: float = 0.999, max_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): of those within max_hashes that find a pair at the threshold with the recall, the ones with most rows a band.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands. A threshold so low that max_hashes do
    not reach the recall takes as many bands of one row as do; a threshold or recall outside (0, 1] and (0, 1) is an error.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError(f"no bands for a threshold of {threshold} and a recall of {recall}")
    needed = lambda rows: 1 if threshold == 1 else math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
    for rows in range(32, 0, -1):
        if threshold**rows > 1e-12 and needed(rows) * rows <= max_hashes:
            return needed(rows), rows
    return needed(1), 1


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of each text in order, and where each text's begin; a text of 1 to n - 1 words is one."""
    b, bounds = W.raw(texts)
    h, _, _, first = W.words(b, bounds)
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), grams)
    begin = np.concatenate(([0], np.cumsum(grams)))
    at = np.arange(len(text)) - begin[text] + first[text]
    last = first[1:][text] - 1
    with np.errstate(over="ignore"):
        s = W.mix(h[at]) if len(at) else np.zeros(0, np.uint64)
        for k in range(1, n):
            ok = at + k <= last
            s = np.where(ok, W.mix(s * _C + h[np.minimum(at + k, last)]), s)
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    s, text = s[new], text[new]
    return s, np.searchsorted(text, np.arange(len(count) + 1))


def _digests(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's set."""
    out = []
    with np.errstate(over="ignore"):
        for v in (W.mix(s ^ np.uint64(0x5851F42D4C957F2D)), W.mix(s * _C)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
            out.append((total[begin[1:]] - total[begin[:-1]]).view(np.int64))
    return out[0], out[1]


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(2024)
    mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("id")
            for lo, hi in W.slices(texts):
                s, begin = shingles(texts.slice(lo, hi - lo), n)
                d1, d2 = _digests(s, begin)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                keys = np.zeros((len(some), bands), dtype=np.uint64)
                if len(some):
                    starts = begin[:-1][some]
                    with np.errstate(over="ignore"):
                        for j in range(bands):
                            key = np.full(len(some), np.uint64(j + 1))
                            for k in range(j * rows, (j + 1) * rows):
                                key = W.mix(key * _C + np.minimum.reduceat((s * mult[k]) >> np.uint64(20), starts))
                            keys[:, j] = key
                lists = np.zeros(hi - lo + 1, dtype=np.int32)
                lists[1:][some] = bands
                col = pa.ListArray.from_arrays(pa.array(np.cumsum(lists).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(d1), pa.array(d2), pa.array(size, pa.int64()), col], names=["id", "d1", "d2", "n", "bands"])

    return run


def _set_maker(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in W.slices(texts):
                s, begin = shingles(texts.slice(lo, hi - lo), n)
                d1, d2 = _digests(s, begin)
                sets = [s[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(d1), pa.array(d2), pa.array(sets, pa.binary())], names=["id", "e1", "e2", "grams"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct numbers in order."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        sim = [jaccard(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every two of a block's sets, from products of their incidence matrix."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    if len(sets) and size.sum():
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size.astype(int))
        _, col, count = np.unique(values, return_inverse=True, return_counts=True)
        several = count[col] > 1  # a gram that one set has meets no other
        col, owner = col[several], owner[several]
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        width = int(col.max()) + 1 if len(col) else 0
        for lo in range(0, width, 4096):
            a, b = np.searchsorted(col, (lo, lo + 4096))
            m = np.zeros((len(sets), min(4096, width - lo)), dtype=np.float32)
            m[owner[a:b], col[a:b] - lo] = 1
            both += m @ m.T
    np.fill_diagonal(both, size)
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def _count_links(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        side, mult = t.column("side").to_numpy(), t.column("mult").to_numpy()
        same = bool((side == 2).any())
        sim = similarities([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")])
        linked = sim >= threshold - 1e-12
        np.fill_diagonal(linked, False)
        if not same:  # pairs of two blocks: those within one are another group's
            linked &= side[:, None] != side[None, :]
        return pa.table({"rep": t.column("rep"), "links": pa.array((linked * mult[None, :]).sum(axis=1).astype(np.int64))})

    return run


def _join_roots(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """(a, b) of roots whose components a pair of this block links; one row a root at most."""
        side = t.column("side").to_numpy()
        root, at = np.unique(t.column("root").to_numpy(), return_inverse=True)
        linked = similarities([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]) >= threshold - 1e-12
        if not (side == 2).any():
            linked &= side[:, None] != side[None, :]
        x, y = np.nonzero(linked & (at[:, None] != at[None, :]))
        x, y = at[x], at[y]
        label = np.arange(len(root))
        while len(x):
            new = label.copy()
            np.minimum.at(new, x, label[y])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(root))
        kind = t.schema.field("root").type
        return pa.table({"a": pa.array(root[moved], kind), "b": pa.array(root[label[moved]], kind)})

    return run


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col, copy_of, class_id, n_links and kept of every row of docs.

    Two documents are linked if the sets of their word n-grams (words as in words.py, case folded; a
    text of fewer words is one gram) have a Jaccard similarity of threshold or more. copy_of is the
    smallest id with the same set, class_id the smallest id that links lead to, n_links the number of
    other rows linked directly (copies included), kept whether the row's id is its class_id. Null and empty
    texts, and texts without words, link with nothing: their class is their own id. Rows with a null id are
    linked as copies of others with the same set only. Extra columns are left out; repeated
    rows are each reported, and link with each other.

    Texts with the same set are one class with one representative. Each band's key groups representatives;
    of a group, pairs are not emitted: everyone is compared with the smallest of all its groups, on whole
    sets. Groups whose members lie in different components after that are compared in full, in blocks of
    block by block sets, and report components to be joined. So every candidate pair is in one component
    already or compared. Links are counted within components, in blocks as well.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    bands, rows = choose_bands(threshold, recall)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    signed = scratch.keep(src.mapInArrow(_signer(n, bands, rows), f"id {id_type}, d1 long, d2 long, n long, bands array<long>"), "signed")
    classes = signed.where("n > 0").groupBy("d1", "d2").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "bands", "n"))).alias("f"), F.count("*").alias("mult")).where("f is not null")
    classes = scratch.keep(classes.select("d1", "d2", F.col("f.id").alias("rep"), "mult", F.col("f.n").alias("n"), F.col("f.bands").alias("bands")), "classes")

    buckets = classes.select("rep", F.explode("bands").alias("bh"))
    heads = buckets.groupBy("bh").agg(F.count("*").alias("c"), F.min("rep").alias("low")).where("c > 1").drop("c")
    met = scratch.keep(buckets.join(heads, "bh"), "met")

    members = met.select("rep").distinct().join(classes.select("rep", "d1", "d2", "mult"), "rep")
    texts = src.join(members.select(F.col("rep").alias("id")), "id", "left_semi")
    made = texts.mapInArrow(_set_maker(n), f"id {id_type}, e1 long, e2 long, grams binary")
    # the digest tells rows that share an id apart
    sets = made.join(members, (made["id"] == members["rep"]) & (made["e1"] == members["d1"]) & (made["e2"] == members["d2"]))
    sets = scratch.keep(sets.select("rep", "d1", "d2", "mult", "grams"), "sets")

    one = sets.select("rep", "grams")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        p = pairs.join(one.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a").join(one.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b")
        return scratch.keep(p.select("a", "b", "x", "y").mapInArrow(_compare, f"a {id_type}, b {id_type}, sim double"), name)

    def labelled(edges: DataFrame) -> DataFrame:
        return scratch.keep(components(edges, scratch), "roots")

    def paired(g: DataFrame, cols: list[str]) -> DataFrame:
        """A group of k blocks as block pairs (lo, hi): a row goes to each with its side, 0 or 1, or 2 for the pairs within one block."""
        g = g.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return g.select(*cols, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"))

    # first: everyone with the smallest of all its groups
    pairs = met.groupBy(F.col("rep").alias("a")).agg(F.min("low").alias("b")).where("b < a")
    star = compared(pairs, "star")
    links = star.where(F.col("sim") >= threshold)
    roots = labelled(links.select("a", "b"))

    # then: groups whose members still lie in different components, in blocks of pairs
    m = met.select("bh", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = m.groupBy("bh").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("bh", F.ceil(F.col("c") / block).cast("int").alias("k"))
    m = paired(m.join(mixed, "bh").join(sets.select("rep", "grams"), "rep"), ["bh", "rep", "root", "grams"])
    joined = scratch.keep(m.groupBy("bh", "lo", "hi").applyInArrow(_join_roots(threshold), f"a {id_type}, b {id_type}"), "joined")
    roots = labelled(links.select("a", "b").unionByName(joined))

    # links within components, in blocks of pairs
    g = sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep")
    blocks = roots.groupBy("root").count().select("root", F.ceil(F.col("count") / block).cast("int").alias("k"))
    g = paired(g.join(blocks, "root"), ["root", "rep", "mult", "grams"])
    counted = g.groupBy("root", "lo", "hi").applyInArrow(_count_links(threshold), f"rep {id_type}, links long")
    counted = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    info = classes.select("d1", "d2", "rep", "mult").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(counted, "rep", "left")
    info = info.select("d1", "d2", "rep", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = signed.select("id", "d1", "d2", "n").join(scratch.keep(info, "info"), ["d1", "d2"], "left")
    some = F.col("n") > 0
    own = F.when(some, F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(some, F.col("rep")).otherwise(F.col("id")).alias("copy_of"), own.alias("class_id"), F.when(some, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.col("id").eqNullSafe(own).alias("kept"))
