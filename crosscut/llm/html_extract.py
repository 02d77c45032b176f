"""Main text by template deduction: tokens with one occurrence vector across a host's pages make its template."""

from __future__ import annotations

import html
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_tokens import CONTAINERS, HEADINGS, INLINE, MATH, SIDE_TAGS, VOID, Stack, clean, walk
from .shared import Aside, Scratch, checked
from .url_filter import url_host

#: A token is frequent if at least this share of the host's pages has it.
SUPPORT = 0.5
NODE_COLUMNS = "host string, path long, parent long, tag string, marked boolean, readers boolean, opens long, closes long, pages long, most long, chars long, links long, lowest long, highest long"
KNOWN_TAGS = INLINE | MATH | HEADINGS | SIDE_TAGS | VOID | frozenset("html body article main section div p ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption details summary address hgroup fieldset center".split())


class Node(NamedTuple):
    """An element path of a host: its occurrence vector (fingerprints of counts by page of its opening and its closing tags), most on one page, and its text."""

    path: int
    parent: int
    tag: str
    marked: bool
    readers: bool
    opens: int
    closes: int
    pages: int
    most: int
    chars: int
    links: int
    lowest: int
    highest: int


class Template(NamedTuple):
    """Paths of the slots with the main text, of elements in them that are none of it, and of elements that are in spite of their names."""

    slots: list[int]
    dropped: list[int]
    spared: list[int]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tokens(source: str) -> dict[int, list]:
    """For each element path of a page but those of side elements: [parent, tag, marked, readers, opened, closed, characters, of these in links, hash of the text]."""
    stack, inside = Stack(), [[0, 0, 0]]
    out: dict[int, list] = {0: [0, "", False, False, 1, 1, 0, 0, 0]}

    def end(paths: list[int], named: bool) -> None:
        for path in paths:
            chars, links, h = inside.pop()
            top = inside[-1]
            top[0], top[1], top[2] = top[0] + chars, top[1] + links, top[2] ^ h
            if (row := out.get(path)) is not None:
                row[5] += named
                row[6], row[7], row[8] = row[6] + chars, row[7] + links, row[8] ^ h

    links = 0  # open elements a
    for kind, *x in walk(source):
        if kind == "open":
            tag = x[0]
            end(stack.open(tag, x[1]), True)
            if tag in VOID:
                stack.close(tag)
                continue
            inside.append([0, 0, 0])
            if not stack.side[-1]:
                row = out.get(stack.paths[-1])
                if row is None:
                    row = out[stack.paths[-1]] = [stack.paths[-2], tag if tag in KNOWN_TAGS else "?", stack.marked[-1], stack.readers[-1], 0, 0, 0, 0, 0]
                row[4] += 1
        elif kind == "close":
            end(stack.close(x[0]), True)
        elif kind == "text" and not stack.side[-1] and (t := x[0].strip()):
            links = stack._open["a"]
            top = inside[-1]
            top[0] += len(t)
            top[1] += len(t) if links else 0
            top[2] ^= xxhash.xxh64_intdigest(t)
    end(stack.paths[:0:-1], False)
    out[0][6:] = inside[0]
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of occurrence vectors, combined for the pages of a batch: sums over pages of a hash of (page, count).

    32 bits of each hash are added up, so a long holds the sum over 2^31 pages of a host.
    """
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not source:
                continue
            page = xxhash.xxh64_intdigest(source)
            for path, (parent, tag, marked, readers, opens, closes, chars, links, h) in _tokens(source).items():
                # every token once on each page has the vector of the page token 0
                a, b = (xxhash.xxh32_intdigest(b"%d %d" % (page, c)) for c in (opens, closes))
                h = _signed(h)
                row = found.get((host, path))
                if row is None:
                    found[host, path] = [_signed(parent), tag, marked, readers, a, b, 1, opens, chars, links, h, h]
                else:
                    row[4] += a
                    row[5] += b
                    row[6] += 1
                    row[7] = max(row[7], opens)
                    row[8] += chars
                    row[9] += links
                    row[10], row[11] = min(row[10], h), max(row[11], h)
        if found:
            cols = [[k[0] for k in found], [_signed(k[1]) for k in found], *([v[i] for v in found.values()] for i in range(12))]
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 8)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in NODE_COLUMNS.split(", ")])


def choose(nodes: Iterable[Node]) -> Template:
    """The template of one host, from the frequent element paths of its pages (path 0 is the page itself).

    Tokens are opening and closing tags. Those with the same occurrence vector are one equivalence class; a
    class is valid if every element of it both opens and closes there. The page's own class is what occurs once
    on every page; with it go the classes that some pages lack and none has twice. Other valid classes are of records
    that repeat. Valid elements nest as their paths do, and what a page has between them fills the slots.

    The main slots are articles of the page's classes, only those whose text changes from page to page if any does;
    else articles of any class if they hold most of the text; else main elements of the page's classes; else the
    deepest element of those with most of the text outside links and side elements. Containers of the template
    within the slots that are the same on all pages, while the pages differ, are left out; paragraphs and headings
    are not, and neither is anything if that would be more than half of the slots' text.
    A marked element that has most of the page's text is main text in spite of its name, unless that is one for comments.
    """
    by_path = {n.path: n for n in nodes}
    page = by_path.get(0)
    if page is None:
        return Template([], [], [])
    # from the page inwards; an element of which the parent is not frequent is put right into the page
    inner: dict[int, list[Node]] = defaultdict(list)
    for n in by_path.values():
        if n.path:
            inner[n.parent if n.parent in by_path else 0].append(n)
    order, around = [page], {0: 0}
    for n in order:
        for m in inner[n.path]:
            around[m.path] = n.path
            order.append(m)
    order = order[1:]

    def below(chosen: set[int]) -> set[int]:
        """What lies within any of the chosen."""
        out: set[int] = set()
        for n in order:
            if around[n.path] in chosen or around[n.path] in out:
                out.add(n.path)
        return out

    classes: dict[tuple[int, int], list[Node]] = defaultdict(list)
    for n in order:
        if n.opens == n.closes:
            classes[n.opens, n.pages].append(n)
    # the page's own class, and those that differ from it only by pages that lack them
    own = [n for members in classes.values() if all(n.most == 1 for n in members) for n in members]
    valid = [n for members in classes.values() for n in members]

    plain = lambda n: n.chars - n.links
    marked = {n.path for n in valid if n.marked}
    nested = below(marked)
    spared = {n.path for n in valid if n.marked and not n.readers and n.path not in nested and 2 * plain(n) > plain(page)}
    hidden = marked - spared
    nested = below(hidden)
    aside = {n.path: plain(n) if n.path in hidden and n.path not in nested else 0 for n in (page, *order)}
    for n in reversed(order):  # text of hidden elements, for all around them
        if n.path not in nested:
            aside[around[n.path]] += aside[n.path]
    prose = lambda n: plain(n) - aside[n.path]
    shown = lambda n: n.path not in hidden and n.path not in nested
    differ = page.lowest != page.highest
    alike = lambda n: differ and n.lowest == n.highest

    def tagged(tag: str, among: Iterable[Node]) -> list[Node]:
        found = {n.path: n for n in among if n.tag == tag and shown(n) and n.chars}
        within = below(set(found))
        found = [n for p, n in found.items() if p not in within]
        changing = [n for n in found if not alike(n)]
        return changing if 2 * sum(n.chars for n in changing) > sum(n.chars for n in found) else found

    every, slots = tagged("article", valid), tagged("article", own)
    most = sum(map(prose, every))
    if 2 * most > prose(page) and 2 * sum(map(prose, slots)) < most:
        slots = every
    slots = slots or tagged("main", own)
    if not slots:
        own_paths = {n.path for n in own}
        near: dict[int, int] = {0: 0}  # the nearest element around it that is of the page's class
        deeper: dict[int, list[Node]] = defaultdict(list)
        for n in order:
            near[n.path] = around[n.path] if around[n.path] in own_paths else near[around[n.path]]
            if n.path in own_paths and n.tag not in INLINE and n.tag not in MATH and n.tag not in HEADINGS and n.tag != "p" and shown(n):
                deeper[near[n.path]].append(n)
        now = page
        while found := [n for n in deeper[now.path] if 2 * prose(n) > prose(now)]:
            now = found[0]
        slots = [now] if now.path else []
    kept = {n.path for n in slots}
    within = below(kept)
    dropped = {n.path for n in own if n.path in within and n.chars and n.tag in CONTAINERS and alike(n)}
    dropped -= below(dropped)
    if 2 * sum(by_path[p].chars for p in dropped) > sum(n.chars for n in slots):
        dropped = set()
    return Template([n.path for n in slots], sorted(dropped), sorted(spared))


def page_template(source: str) -> Template:
    """The template of one page by itself."""
    return choose(Node(_signed(path), _signed(parent), tag, marked, readers, opens, closes, 1, opens, chars, links, h, h) for path, (parent, tag, marked, readers, opens, closes, chars, links, h) in _tokens(source).items())


def deduce_templates(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """(host, slots, dropped, spared): the template of every host, as choose makes it from the host's frequent tokens.

    A token is frequent if at least support of the host's pages have it, so a host has no more of them than some pages
    have, however many paths its pages have in all (a class attribute with a number is enough for one a page).
    Vectors combine in each batch and before the shuffle, so a host with very many pages makes no large group.
    """
    names = [c.split()[0] for c in NODE_COLUMNS.split(", ")]
    v = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_nodes, NODE_COLUMNS)
    v = v.groupBy("host", "path").agg(*[F.min(c).alias(c) for c in ("parent", "tag")], *[F.bool_or(c).alias(c) for c in ("marked", "readers")], *[F.sum(c).alias(c) for c in ("opens", "closes", "pages", "chars", "links")], F.max("most").alias("most"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    v = scratch.keep(v, "vectors")
    page = v.where("path = 0").select(F.col("host").alias("_h"), F.col("pages").alias("_n"))
    frequent = v.join(page, F.col("host") == F.col("_h")).where(F.col("pages") >= F.lit(float(support)) * F.col("_n"))
    each = frequent.groupBy("host").agg(F.collect_list(F.struct(*names[1:])).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [choose(Node(**n) for n in nodes) for nodes in batch.column("nodes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array([t[i] for t in made], pa.list_(pa.int64())) for i in range(3))], names=["host", "slots", "dropped", "spared"])

    return each.mapInArrow(run, "host string, slots array<long>, dropped array<long>, spared array<long>")


def _within(source: str, template: Template) -> tuple[bool, list[str]]:
    """(whether the page has a slot, the blocks in its slots); without slots in the template, all blocks of the page."""
    slots, dropped, spared = (frozenset(p) for p in template)
    stack = Stack()
    # for each open element: whether it lies in a slot, and whether it is left out
    state = [(not slots, False)]
    found: list[str] = []
    parts: list[str] = []
    met = not slots

    def flush() -> None:
        if parts:
            if block := clean(parts):
                found.append(block)
            parts.clear()

    for kind, *x in walk(source):
        if kind == "text":
            inside, out = state[-1]
            if inside and not out and not stack.side[-1]:
                parts.append(html.unescape(x[0]))
            continue
        if kind == "raw":
            continue
        tag = x[0]
        if tag == "br" and kind == "open":
            parts.append(" ")
        elif tag not in INLINE and tag not in MATH:
            flush()
        if kind == "open":
            for _ in stack.open(tag, x[1]):
                state.pop()
            if tag in VOID:
                stack.close(tag)
                continue
            path = _signed(stack.paths[-1])
            inside, out = state[-1]
            here = path in slots
            met = met or here
            # a slot is told by the template, so what is around it does not leave it out
            out = False if here else out or path in dropped or (stack.marked[-1] and path not in spared)
            state.append((inside or here, out))
        else:
            for _ in stack.close(tag):
                state.pop()
    flush()
    return met, found


def main_text(source: str, template: Template) -> str:
    """The blocks of text in the template's slots, side elements and what the template drops left out, each on a line.

    Side elements are known by their tag, or by a class, role or id all of whose words name such. A page that has none of
    the slots, as of another layout than most of its host, has a template deduced from itself alone; if that has no slot
    either, all its blocks count.
    """
    met, found = _within(source, template)
    if not met or not template.slots:
        found = _within(source, page_template(source))[1]
    return "\n".join(found)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but the html without it) of every row of pages with text and n_chars (code points).

    Character references are decoded, white space within a block is one space, blocks are joined by \\n
    in page order. A null or empty html gives an empty text. Pages without :// in their url share
    the empty host. Repeated rows are each extracted. Columns named text or n_chars are replaced, others may have any name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(pages.sparkSession, "html")
    keep = [c for c in (keep if keep is not None else [c for c in pages.columns if c != html_col]) if c not in ("text", "n_chars")]
    aside = Aside(pages)
    pages, url_col, html_col, keep = aside.df, aside.name(url_col), aside.name(html_col), aside.names(keep)
    slots = checked(scratch.keep(deduce_templates(pages, scratch, url_col, html_col), "slots"))
    rows = pages.select(*keep, url_host(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html")).join(slots, F.col("_host") == F.col("host"), "left").select(*keep, "_html", "slots", "dropped", "spared")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = pc.fill_null(batch.column("_html"), "")
            parts = [batch.column(c) for c in ("slots", "dropped", "spared")]
            for k in range(0, len(batch), 256):
                rows = zip(*(c.slice(k, 256).to_pylist() for c in (sources, *parts)), strict=True)
                texts = [main_text(s, Template(*(t or [] for t in template))) if s else "" for s, *template in rows]
                cols = [batch.column(c).slice(k, 256) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return aside.back(rows.mapInArrow(run, schema))
