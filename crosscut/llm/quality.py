"""A quality score by a sparse ensemble of rules: tree paths over text statistics with lasso logistic weights."""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import Aside

STATS = ["log_bytes", "upper", "digit", "space", "newline", "comma_dot", "symbol", "bar", "mark", "non_ascii", "word_len", "distinct_words", "odd_words", "line_words", "mark_pairs", "capital_words", "stop_like"]
#: Labelled rows that a fit reads at most; taken by the smallest hashes of their ids.
MAX_TRAIN_ROWS = 20_000
#: Penalties that cross-validation chooses from, the sparsest first, and its folds. The least keeps some 150 rules, which
#: still fit in generated code.
PENALTIES, FOLDS = (1e-2, 3e-3, 1e-3), 3

_CLASS = np.zeros(256, dtype=np.int8)  # 0 is other
for _name, _chars in {1: range(65, 91), 2: range(48, 58), 3: b" \t\r\x0b\x0c", 4: b"\n", 5: b".,", 6: b"#$%&*+/<=>@\\^_`{}~[]()", 7: b"|", 8: b"!?;:\"'-", 9: range(128, 256)}.items():
    for _c in _chars:
        _CLASS[_c] = _name


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each whole text; all zero for an empty or null one."""
    out = []
    for lo, hi in W.slices(texts):
        b, bounds = W.raw(texts.slice(lo, hi - lo))
        n = np.diff(bounds)
        safe = np.maximum(n, 1)
        kinds = _CLASS[b]
        share = {k: _sums(kinds == k, bounds) / safe for k in range(1, 10)}
        h, s, e, first = W.words(b, bounds)
        words = np.diff(first)
        some = np.maximum(words, 1)
        text = np.repeat(np.arange(len(n)), words)
        # distinct words of each text: sort by text, then hash
        order = np.lexsort((h, text))
        hs, ts = h[order], text[order]
        new = np.ones(len(hs), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
        size = e - s
        # a word that a symbol or ! follows, or a bar surrounds, is odd; one that a letter in capitals begins, capital
        after = np.where(e < len(b), b[np.minimum(e, max(len(b) - 1, 0))], 32) if len(b) else np.zeros(0, np.uint8)
        odd = np.isin(_CLASS[after], (6, 7)) | (after == 33)
        capital = (_CLASS[b[s]] == 1) if len(s) else np.zeros(0, bool)
        pairs = np.zeros(len(b), dtype=bool)
        if len(b) > 1:
            pairs[1:] = (b[1:] == b[:-1]) & np.isin(kinds[1:], (6, 7, 8))
        lines = _sums(kinds == 4, bounds) + 1
        out.append(
            np.column_stack(
                [
                    np.log1p(n),
                    *(share[k] for k in range(1, 10)),
                    np.bincount(text, size, len(n)) / some,
                    np.bincount(ts, new, len(n)) / some,
                    np.bincount(text, odd, len(n)) / some,
                    np.log1p(words / lines) * (words > 0),
                    _sums(pairs, bounds) / safe,
                    np.bincount(text, capital, len(n)) / some,
                    np.bincount(text, size <= 3, len(n)) / some,
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns of docs and the struct _stats of its text's statistics; one pass, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("_stats", T.StructType([T.StructField(c, T.DoubleType()) for c in STATS]))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(source))
            stats = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATS))], names=STATS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats], schema=arrow)

    # a text that is kept crosses to Python once
    source = text_col if text_col in keep else next(c for k in itertools.count() if (c := f"_text{k}") not in keep)
    return docs.select(*keep, *([] if source in keep else [F.col(text_col).alias(source)])).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, above, bound) that all hold, and what they add to the log odds."""

    when: tuple[tuple[int, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def dumps(self) -> str:
        return json.dumps([self.bias, [[r.when, r.weight] for r in self.rules]])

    @staticmethod
    def loads(text: str) -> Model:
        bias, rules = json.loads(text)
        return Model(bias, tuple(Rule(tuple(tuple(c) for c in when), weight) for when, weight in rules))

    def column(self, stats: str = "_stats") -> Column:
        """The score as one column expression."""
        parts = [F.lit(self.bias)]
        for r in self.rules:
            holds = F.lit(True)
            for i, above, bound in r.when:
                v = F.col(f"{stats}.{STATS[i]}")
                holds = holds & ((v > bound) if above else (v <= bound))
            parts.append(F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0)))
        while len(parts) > 1:  # a balanced tree of sums, not a deep one
            parts = [parts[k] + parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-parts[0]))


def _holds(x: np.ndarray, when: tuple) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for i, above, bound in when:
        ok &= (x[:, i] > bound) if above else (x[:, i] <= bound)
    return ok


def _tree_paths(x: np.ndarray, residual: np.ndarray, depth: int, cuts: list[np.ndarray], rng: np.random.Generator) -> list[tuple]:
    """Fits a regression tree; gives its leaves as paths with their mean residual, and all inner paths."""
    paths: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append((path, rows))
        if len(path) == depth or len(rows) < 20:
            return
        r = residual[rows]
        best = (1e-9, None, None)
        base = r.sum() ** 2 / len(r)
        for i in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
            at = np.searchsorted(cuts[i], x[rows, i], side="left")  # value <= cuts[k] for k >= at
            n = np.cumsum(np.bincount(at, minlength=len(cuts[i]) + 1))[:-1]
            s = np.cumsum(np.bincount(at, r, len(cuts[i]) + 1))[:-1]
            m = len(r) - n
            ok = (n >= 10) & (m >= 10)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(m, 1) - base, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(i), float(cuts[i][k]))
        if best[1] is None:
            return
        low = x[rows, best[1]] <= best[2]
        grow(rows[low], (*path, (best[1], False, best[2])))
        grow(rows[~low], (*path, (best[1], True, best[2])))

    grow(np.arange(len(x)), ())
    return paths


def _weights(y: np.ndarray) -> np.ndarray:
    """The two classes count alike."""
    return np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))


def boost_paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[tuple]:
    """The paths of boosted small trees, each once: conjunctions of conditions on the statistics."""
    rng = np.random.default_rng(seed)
    share = _weights(y)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0.02, 0.98, 40))) for i in range(x.shape[1])]
    margin, seen = np.zeros(len(y)), {}
    for _ in range(trees):
        pick = rng.permutation(len(y))[: max(50, len(y) // 2)]
        p = 1 / (1 + np.exp(-margin))
        res = (y - p) * share
        paths = _tree_paths(x[pick], res[pick], depth, cuts, rng)
        inner = {q[:k] for q, _ in paths for k in range(1, len(q))}
        for q, rows in paths:
            seen.setdefault(tuple(sorted(q)), None)
            if q not in inner:
                h = (share[pick[rows]] * p[pick[rows]] * (1 - p[pick[rows]])).sum() + 1
                margin[_holds(x, q)] += 0.5 * res[pick[rows]].sum() / h
    return list(seen)


def _matrix(x: np.ndarray, when: list[tuple]) -> np.ndarray:
    """Which rows each rule holds for, as numbers of 4 bytes."""
    out = np.empty((len(x), len(when)), dtype=np.float32)
    for k, q in enumerate(when):
        out[:, k] = _holds(x, q)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float] | None = None, rounds: int = 600) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on the columns of a (0 or 1) with an L1 penalty on the weights, by accelerated steps."""
    share = _weights(y) / len(y)
    w, b = (np.zeros(a.shape[1], dtype=a.dtype), 0.0) if start is None else start
    z, zb, t = w, b, 1.0
    step = 1.0 / (0.25 * max(1.0, float(a.sum(axis=1).max(initial=0.0))) * share.max() * len(y))
    for _ in range(rounds):
        # by einsum, on one thread: the driver's others are Spark's
        g = (1 / (1 + np.exp(-(np.einsum("ij,j->i", a, z) + zb))) - y) * share
        nw = z - step * np.einsum("ij,i->j", a, g.astype(a.dtype))
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)).astype(a.dtype)
        nb = zb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = (nw + (t - 1) / nt * (nw - w)).astype(a.dtype), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def choose_penalty(x: np.ndarray, y: np.ndarray, fold: np.ndarray, trees: int, depth: int, seed: int, penalties: tuple[float, ...] = PENALTIES) -> float:
    """The largest penalty of which the loss on rows left out of a fit is within one standard error of the least."""
    loss = []  # a row for each fold, a column for each penalty
    for f in range(FOLDS):
        train, test = fold != f, fold == f
        if not test.any() or len(np.unique(y[train])) < 2:
            continue
        when = boost_paths(x[train], y[train], trees, depth, seed)
        a, b = _matrix(x[train], when), _matrix(x[test], when)
        share, fit, row = _weights(y[train]), None, []
        weight = np.where(y[test] == 1, share[y[train] == 1][0], share[y[train] == 0][0])
        for penalty in penalties:  # from sparse to dense, each from where the one before ended
            fit = lasso(a, y[train], penalty, fit, 250)
            p = np.clip(1 / (1 + np.exp(-(np.einsum("ij,j->i", b, fit[0]) + fit[1]))), 1e-6, 1 - 1e-6)
            row.append((weight * -np.where(y[test] == 1, np.log(p), np.log(1 - p))).mean())
        loss.append(row)
    if not loss:
        return penalties[0]
    mean = np.mean(loss, axis=0)
    best = int(mean.argmin())
    error = np.std([r[best] for r in loss]) / np.sqrt(len(loss))
    return next(p for p, m in zip(penalties, mean, strict=True) if m <= mean[best] + error)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float | None = None, seed: int = 7, fold: np.ndarray | None = None) -> Model:
    """Boosts small trees, takes their paths as rules, and weighs these by lasso logistic regression.

    Without a penalty, it is chosen by cross-validation over the folds of these rows (dealt in turn if no fold
    is given). The two classes count alike. With one class only, or no rows, the score is that class's (or 0.5)
    for every text. Reruns agree.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model(0.0 if len(y) == 0 else (3.0 if y[0] else -3.0), ())
    if penalty is None:
        penalty = choose_penalty(x, y, np.arange(len(y)) % FOLDS if fold is None else fold, trees, depth, seed)
    when = boost_paths(x, y, trees, depth, seed)
    if not when:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = _matrix(x, when)
    w, b = lasso(a, y, penalty)
    mean = a.mean(axis=0, dtype=np.float64)
    kept = [k for k in np.flatnonzero(np.abs(w) > 1e-6) if 0 < mean[k] < 1]
    b += float(sum(w[k] for k in np.flatnonzero(mean >= 1)))
    return Model(float(b), tuple(Rule(when[k], float(w[k])) for k in kept))


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from every fit: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fits on at most max_rows labelled documents that are not held out, those with the smallest hashes of their ids.

    The penalty is chosen by cross-validation inside these rows. Labels other than 0 and 1 and null ids are left
    out. An id labelled twice counts with its lowest label, one with several texts with that of the lowest
    statistics. Labels, lang, source and ids are no inputs of the score.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    mine = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    mine = mine.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = spark.createDataFrame(mine.collect(), mine.schema)  # max_rows at most
    rows = with_statistics(docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]), ["_id", "_y"], text_col)
    rows = rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_stats").alias("_stats"))
    made = rows.groupBy(F.lit(0).alias("_g")).applyInArrow(_fit_table, "model string").collect()  # one task, max_rows at most
    return Model.loads(made[0]["model"]) if made else Model(0.0, ())


def _fit_table(t: pa.Table) -> pa.Table:
    """The model of all rows (_id, _y, _stats), as text. It is fitted in a task, which the driver need not have the memory for."""
    t = t.sort_by("_id")
    stats = t.column("_stats").combine_chunks()
    x = np.column_stack([stats.field(c).to_numpy(zero_copy_only=False) for c in STATS])
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in t.column("_id").to_pylist()], dtype=np.int64)
    model = fit_rules(x, t.column("_y").to_numpy().astype(np.float64), fold=fold)
    return pa.table({"model": [model.dumps()]})


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns of every row with score (0 to 1) and predicted (1 from 0.5 on); empty texts get the score of zero statistics.

    Columns of keep named score or predicted are replaced, others may have any name.
    """
    aside = Aside(docs)
    names = aside.names([c for c in keep if c not in ("score", "predicted")])
    s = with_statistics(aside.df, names, aside.name(text_col)).withColumn("score", model.column())
    return aside.back(s.select(*names, "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
