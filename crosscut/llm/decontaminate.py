"""Removing benchmark passages: a generalised suffix automaton of the items, and training words streamed through it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import Aside, Scratch

#: Words of items in one automaton; more items make more automata, run one after another.
MAX_BLOCK_WORDS = 200_000
_C = np.uint64(0x9FB21C651E98DF25)


class Screen:
    """Finds word ranges that may hold a window, by a table of hashed pairs of neighbouring item words (or of single
    words if an item has one word): a window holds no other pair."""

    def __init__(self, least: int, bits: int = 22):
        self.least, self.bits = least, bits
        self.table = np.zeros(1 << bits, dtype=bool)

    def add(self, seq: list[bytes]) -> None:
        b = b" ".join(seq)
        h, *_ = W.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        self.table[self.slots(h)] = True

    def slots(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            pairs = W.mix(h[:-1] * _C + h[1:]) if self.least > 1 else h
        return (pairs >> np.uint64(64 - self.bits)).astype(np.int64)

    def runs(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges, within one text each, that may hold a window."""
        need = max(1, self.least - 1)
        if len(h) < self.least or not self.least:
            return []
        ok = self.table[self.slots(h)]
        wide = int(self.least > 1)
        inner = first[1:-1]
        if wide:
            inner = inner[(inner > 0) & (inner <= len(ok))]
            ok[inner - 1] = False
        edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = hi - lo >= need
        out = list(zip(lo[keep].tolist(), (hi[keep] + wide).tolist(), strict=True))
        if wide:
            return out
        cuts = inner.tolist()
        return [(max(a, s), min(b, e)) for a, b in out for s, e in zip([0, *cuts], [*cuts, len(h)], strict=True) if max(a, s) < min(b, e)]

    def suspects(self, texts: pa.Array) -> tuple[list[int], list[bool]]:
        """For each text: its words, and whether it may hold a window."""
        counts, flags = [], []
        for lo, hi in W.slices(texts):
            b, bounds = W.raw(texts.slice(lo, hi - lo))
            h, _, _, first = W.words(b, bounds)
            flag = np.zeros(hi - lo, dtype=bool)
            starts = np.array([x for x, _ in self.runs(h, first)], dtype=np.int64)
            flag[np.searchsorted(first, starts, side="right") - 1] = True
            counts += np.diff(first).tolist()
            flags += flag.tolist()
        return counts, flags


class Automaton(Screen):
    """Recognises every run of words that occurs in some item, and the items of each window of n words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], n: int):
        self.n = n
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: by window length: state of that window -> items; lengths below n are of whole short items
        self.owners: dict[int, dict[int, set]] = {}
        for key, seq in items:
            size = min(n, len(seq))
            own = self.owners.setdefault(size, {})
            for at, state, length in self.follow(seq):
                if length >= size and at + 1 >= size:
                    own.setdefault(self.cut(state, size), set()).add(key)
        self.sizes = sorted(self.owners)
        super().__init__(self.sizes[0] if self.sizes else 0)
        for _, seq in items:
            self.add(seq)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def cut(self, state: int, size: int) -> int:
        """The state of the last size words of what state stands for."""
        while self.len[self.link[state]] >= size and self.link[state] > 0:
            state = self.link[state]
        return state

    def follow(self, seq: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match that ends here) for each word."""
        state = length = 0
        nxt, link, lens = self.next, self.link, self.len
        for at, w in enumerate(seq):
            while state and w not in nxt[state]:
                state = link[state]
                length = lens[state]
            to = nxt[state].get(w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield at, state, length


_cache: dict[str, Automaton] = {}


def _automaton(key: str, items: list, n: int) -> Automaton:
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton([(i, W.word_list(t)) for i, t in items], n)
    return _cache[key]


def matches(auto: Automaton, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]], list]]:
    """For each text: its words, words hit, spans (first byte, end byte, words, longest match) and items."""
    for lo, hi in W.slices(texts):
        b, bounds = W.raw(texts.slice(lo, hi - lo))
        h, s, e, first = W.words(b, bounds)
        found: dict[int, tuple[list, set]] = {}
        folded = None
        for x, y in auto.runs(h, first):
            if folded is None:
                folded = W.FOLD[b].tobytes()
            seq = [folded[i:j] for i, j in zip(s[x:y].tolist(), e[x:y].tolist(), strict=True)]
            spans: list[list[int]] = []
            items: set = set()
            for at, state, length in auto.follow(seq):
                for size in reversed(auto.sizes):
                    if length >= size and (own := auto.owners[size].get(auto.cut(state, size))):
                        items |= own
                        a = at - size + 1
                        while spans and a <= spans[-1][1] + 1:
                            a = min(a, spans[-1][0])
                            length = max(length, spans.pop()[2])
                        spans.append([a, at, length])
            if spans:
                text = int(np.searchsorted(first, x, side="right")) - 1
                got = found.setdefault(text, ([], set()))
                got[0].extend((x + a, x + z, m) for a, z, m in spans)
                got[1].update(items)
        for k in range(hi - lo):
            spans, items = found.get(k, ((), ()))
            base = int(bounds[k])
            yield int(first[k + 1] - first[k]), sum(z - a + 1 for a, z, _ in spans), [(int(s[a]) - base, int(e[z]) - base, z - a + 1, m) for a, z, m in spans], list(items)


def _join_spans(a: list[tuple], b: list[tuple]) -> list[list]:
    """Spans of either list, overlapping ones joined. Bytes between two words of one run belong to neither, so words are
    counted from the span that ends later."""
    out: list[list] = []
    for x in sorted([*a, *b]):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
            out[-1][3] = max(out[-1][3], x[3])
        else:
            out.append(list(x))
    return out


def _matcher(key: str, items: list, n: int, source: str, passed: list[str], before: bool, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(key, items, n)
        names = ("start", "end", "words", "longest")
        for batch in batches:
            texts = batch.column(source)
            got = [list(g) for g in matches(auto, texts)]
            if before:
                for k, (spans, owners) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    if spans:
                        joined = _join_spans([tuple(x[c] for c in names) for x in spans], got[k][2])
                        text = texts[k].as_py().encode()
                        for x in joined:
                            x[2] = len(W.word_list(text[x[0] : x[1]].decode()))
                        got[k][1:] = [sum(x[2] for x in joined), [tuple(x) for x in joined], [*{*owners, *got[k][3]}]]
            cols = [batch.column(c) for c in passed] + [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())]
            cols.append(pa.array([[dict(zip(names, x, strict=True)) for x in g[2]] for g in got], schema.field("spans").type))
            cols.append(pa.array([g[3] for g in got], schema.field("items").type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def find_spans(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """keep's columns of every row of docs with n_words, n_hit, spans and items.

    Words are runs of 0-9, A-Z (folded), a-z and non-ASCII characters. A window is n consecutive words
    of an item, or a whole item of fewer. spans holds the joined occurrences of windows as UTF-8 byte
    ranges (start, end) with their words and the longest match of item words that ends in them; items
    the distinct ids of items with a window there. A null or empty text has no words; an item
    without words no window; an empty item table finds nothing. Rows of items that share an id are
    one item; those without an id are one too, a null in items. Repeated rows of docs are each reported. keep's columns named as the four added are replaced, others may have any name.

    Items are dealt by a hash of their ids to automata of about max_block_words words; an item is never
    parted, so one with very many words makes its automaton larger. If one holds them all, docs are read once and nothing is shuffled. Otherwise
    documents that may hold a window are screened first, by one table of hashed word pairs of all items (of 64 MB at
    most), and written to the shared folder; only these go through one automaton after another, with what was found
    written in between.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(docs.sparkSession, "spans")
    added = ("n_words", "n_hit", "spans", "items")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    span_type = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType(), True) for c in ("start", "end", "words", "longest")]))
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span_type), T.StructField("items", T.ArrayType(items.schema[item_id].dataType))]

    # a word and what parts it from the next are two characters at least, so this bounds the words
    sized = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).withColumn("w", F.ceil(F.length("t") / 2) + 1)
    blocks = max(1, -(-int(sized.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]) // max_block_words))
    block = lambda k: [(r["i"], r["t"]) for r in sized.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).select("i", "t").collect()]
    # a text that is kept crosses to Python once
    aside = Aside(docs)
    keep, source = aside.names(keep), aside.name(text_col)
    extra = [] if source in keep else [source]
    now, clean = aside.df.select(*keep, *extra), None
    if blocks > 1:
        least, total = n, 0
        for k in range(blocks):
            for _, t in block(k):
                if w := W.word_list(t):
                    least, total = min(least, len(w)), total + len(w)
        screen = Screen(least if total else 0, min(26, max(22, (16 * total).bit_length())))
        for k in range(blocks):
            for _, t in block(k):
                if w := W.word_list(t):
                    screen.add(w)
        now, clean = _screened(now, screen, source, keep, found, scratch)
    for b in range(blocks):
        rows = block(b)
        passed = [*keep, *extra] if b < blocks - 1 else keep
        schema = T.StructType([now.schema[c] for c in passed] + found)
        arrow = to_arrow_schema(schema)
        digest = hashlib.sha256(repr((n, rows)).encode()).hexdigest()
        out = now.mapInArrow(_matcher(digest, rows, n, source, passed, b > 0, arrow), schema)
        if b < blocks - 1:
            written = scratch.keep(out)
            if b:
                scratch.drop(now)
            now = written
        else:
            now = out
    return aside.back(now if clean is None else now.unionByName(clean))


def _screened(docs: DataFrame, screen: Screen, source: str, keep: list[str], found: list, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows that may hold a window, and the others as they come out of find_spans). A text that is not kept is written for the former only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*docs.schema, T.StructField("_n", T.LongType()), T.StructField("_maybe", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(source)
            counts, flags = screen.suspects(text)
            maybe = pa.array(flags, pa.bool_())
            cols = {c: batch.column(c) for c in batch.schema.names}
            if source not in keep:
                cols[source] = pc.if_else(maybe, text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(counts, pa.int64()), maybe], schema=arrow)

    rows = scratch.keep(docs.mapInArrow(run, schema), "screened")
    kinds = {f.name: f.dataType for f in found}
    none = [F.col("_n").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *[F.array().cast(kinds[c]).alias(c) for c in ("spans", "items")]]
    return rows.where("_maybe").select(*docs.columns), rows.where("not _maybe").select(*keep, *none)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10, max_coverage: float = 0.5, text_col: str = "text", **kwargs) -> DataFrame:
    """docs with the spans of find_spans cut out of text_col; rows of which spans cover more than max_coverage of the words go.

    A span is cut with what lies between its words, and one space stays in its place. All columns
    keep their names and types, n_chars (if there) counts the new text; other columns may have any name. Texts without a span stay as they are.
    """
    aside = Aside(docs)
    chars, docs, text_col = aside.name("n_chars") if "n_chars" in docs.columns else None, aside.df, aside.name(text_col)
    out = find_spans(docs, items, n, text_col, **kwargs)
    raw = F.encode(F.col(text_col), "UTF-8")
    # what stays: from the end of each span (or the start of the text) to the start of the next (or the end)
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(F.col(text_col))))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.decode(F.substring(raw, p["a"] + 1, p["b"] - p["a"]), "UTF-8"))
    new = F.when(F.size("spans") == 0, F.col(text_col)).otherwise(F.array_join(kept, " "))
    out = out.where((F.col("n_hit") <= F.col("n_words") * F.lit(float(max_coverage)))).withColumn(text_col, new)
    if chars:
        out = out.withColumn(chars, F.when(F.size("spans") == 0, F.col(chars)).otherwise(F.length(text_col).cast(docs.schema[chars].dataType)))
    return aside.back(out.select(*docs.columns))
