"""Comments and strings of source lines: an automaton over lines whose state says what a line begins in.

A line can begin in code (0), in one of two kinds of text that run over lines (1, 2), in a block comment of Ruby (3) or in one of its here
documents (4). Scanning a line that begins in a text is scanning it with the text's opening mark in front, so one regular expression a
language finds all tokens, and what the last of them leaves open is the next line's state. States fold over the lines of
each content where it lies: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import structural_language

#: Lines that one step of the fold handles, so that lists are copied in pieces.
CHUNK = 256

_QUOTED = r""""[^"]*(?:"|\z)|'[^']*(?:'|\z)"""
_BRACES = r"(?s)//.*|/\*.*?(?:\*/|\z)|" + _QUOTED + r"|`[^`]*(?:`|\z)"
# a slash that no value stands before begins a regular expression
_REGEX = r"|(?<=(?:^|[(,=:\[!&|?{};+\-*%~^<>]|\breturn)\s{0,4})/(?![/*\s])[^/\[]*(?:\[[^\]]*\][^/\[]*)*+/[a-z]*"
_PYTHON = r"""(?s)#.*|[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|"[^"]*(?:"|\z)|'[^']*(?:'|\z))"""
_RUBY = r"""(?s)^=begin.*|#.*|<<[~-]?(['"]?)[A-Z_]\w*\1|""" + _QUOTED + r"|(?<![:\w]):[A-Za-z_]\w*"
#: For each language: tokens, what a backslash hides, and the opening and closing marks of states 1 and 2.
LANGUAGES = {
    "typescript": (_BRACES + _REGEX, r"\\[\\\"'`/]", ("/*", "`"), ("*/", "`")),
    "javascript": (_BRACES + _REGEX, r"\\[\\\"'`/]", ("/*", "`"), ("*/", "`")),
    "go": (_BRACES, r"\\[\\\"']", ("/*", "`"), ("*/", "`")),
    "python": (_PYTHON, r"\\[\\\"']", ('"""', "'''"), ('"""', "'''")),
    "ruby": (_RUBY, r"\\[\\\"']", ('"', "'"), ('"', "'")),
}


#: A line that begins in code and has none of these characters holds no comment and no string, and ends in code.
SIGNS, RUBY_SIGNS = r"""[/"'`#]""", r"""[#"':<]|^=begin"""


def _no_sign(line: Column) -> Column:
    return ~F.when(F.col("language") == "ruby", line.rlike(RUBY_SIGNS)).otherwise(line.rlike(SIGNS))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unfiltered(values: Column) -> Column:
    """values, to be exploded. Of a bare column Spark would ask first, in a filter put before the projection that makes it, whether it has
    values, and so make it, and what it is made of, several times.
    """
    return F.transform(values, lambda v: v)


def _by_language(pick: Callable[[tuple], Column]) -> Column:
    out = F.when(F.lit(False), pick(LANGUAGES["go"]))
    for name, spec in LANGUAGES.items():
        out = out.when(F.col("language") == name, pick(spec))
    return out


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _settings() -> dict[str, Column]:
    return {
        "tokens": _by_language(lambda s: F.lit(s[0])),
        "hidden": _by_language(lambda s: F.lit(s[1])),
        "openers": _by_language(lambda s: _strings(("", *s[2], "=begin"))),
        "closers": _by_language(lambda s: _strings(s[3])),
    }


def _plain(line: Column) -> Column:
    """The line, as long as it was, without quotes that a backslash hides."""
    return F.regexp_replace(line, F.col("hidden"), F.lit("__"))


def _left_open(token: Column) -> Column:
    """The state that a line's last token leaves."""
    core = F.regexp_replace(token, r"^[rRbBuUfF]{1,2}(?=[\"'])", "")

    def state(k: int, c: Column) -> Column:
        o, e = F.get("openers", F.lit(k)), F.get("closers", F.lit(k - 1))
        return c.startswith(o) & ~((F.length(c) >= F.length(o) + F.length(e)) & c.endswith(e))

    begun = lambda c: c.startswith("=begin") & ~c.startswith("=begin=end")
    return let(core, lambda c: F.when(c.isNull(), 0).when(state(1, c), 1).when(state(2, c), 2).when(begun(c), 3).otherwise(0)).cast("int")


def _after(state: Column, line: Column) -> Column:
    """(s, tag) after a line that begins in a state (s, tag)."""
    opener = F.coalesce(F.get("openers", state["s"]), F.lit(""))
    mark = r"^<<[~-]?['\"]?([A-Z_]\w*)"

    def scanned(found: Column) -> Column:
        here = F.get(F.filter(found, lambda t: t.rlike(mark)), F.lit(0))
        tag = F.when(F.col("language") == "ruby", F.regexp_extract(here, mark, 1))
        return F.struct(F.when(tag.isNotNull(), 4).otherwise(_left_open(F.try_element_at(found, F.lit(-1)))).alias("s"), tag.alias("tag"))

    ended = F.struct(F.lit(0).alias("s"), F.lit(None).cast("string").alias("tag"))
    return F.when((state["s"] == 0) & _no_sign(line), state).when((state["s"] == 4) & (F.trim(line) == state["tag"]), ended).when(state["s"] == 4, state).otherwise(let(F.regexp_extract_all(F.concat(opener, _plain(line)), F.col("tokens"), F.lit(0)), scanned))


def _states(lines: Column) -> Column:
    """What each line begins in, and at last what follows the last line."""
    start = F.struct(F.lit(0).alias("s"), F.lit(None).cast("string").alias("tag"))
    none = F.array().cast("array<int>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / CHUNK)), lambda k: F.slice(lines, (k * CHUNK + 1).cast("int"), F.lit(CHUNK)))

    def in_chunk(acc: Column, line: Column) -> Column:
        return F.struct(_after(acc["at"], line).alias("at"), F.array_append(acc["out"], acc["at"]["s"]).alias("out"))

    def over(acc: Column, chunk: Column) -> Column:
        one = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), in_chunk)
        return let(one, lambda o: F.struct(o["at"].alias("at"), F.array_append(acc["out"], o["out"]).alias("out")))

    whole = F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast("array<array<int>>").alias("out")), over)
    return let(whole, lambda w: F.array_append(F.flatten(w["out"]), w["at"]["s"]))


def _blank(token: Column, closed: Column) -> Column:
    """As many characters, without what is in a comment or string; a string keeps a quote where it begins and where it ends."""
    n = F.length(token)
    comment = token.rlike(r"^(?://|/\*|#|=begin)")
    return F.when(comment, F.repeat(F.lit(" "), n)).when((n >= 2) & closed, F.concat(F.lit('"'), F.repeat(F.lit(" "), n - 2), F.lit('"'))).otherwise(F.rpad(F.lit('"'), n, F.lit(" ")))


def source_lines(files: DataFrame) -> DataFrame:
    """file_key, language, line (from 1), text, code, begins, ends and spans of (file_key, filename, content).

    begins and ends are the states before and after a line; code is its text with comments blank and strings empty, each character in its
    place; spans are (start, end, kind) of its comments and strings. Languages that are not read, and null contents, give no rows.
    """
    x = files.select("file_key", structural_language(F.col("filename")).alias("language"), "content").where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull())
    x = x.withColumns(_settings()).withColumn("lines", F.split("content", "\n"))
    x = x.withColumn("states", _states(F.col("lines"))).select("file_key", "language", "tokens", "hidden", "openers", "states", F.posexplode(unfiltered(F.col("lines"))).alias("at", "text"))
    x = x.withColumns({"begins": F.get("states", F.col("at")), "ends": F.get("states", F.col("at") + 1)}).drop("states")
    opener = F.coalesce(F.get("openers", F.col("begins")), F.lit(""))
    x = x.withColumns({"mark": F.length(opener), "plain": F.concat(opener, _plain(F.col("text")))})
    here, bare = F.col("begins") == 4, (F.col("begins") == 0) & _no_sign(F.col("text"))
    x = x.withColumns({"found": F.when(here, F.array("plain")).when(bare, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("plain", F.col("tokens"), F.lit(0))), "between": F.when(here, F.array(F.lit(""), F.lit(""))).when(bare, F.array("plain")).otherwise(F.split("plain", F.col("tokens"), -1))})

    def add(acc: Column, k: Column) -> Column:
        token = F.get("found", k)
        start = acc["at"] + F.length(F.get("between", k))
        kind = F.when(~here & token.rlike(r"^(?://|/\*|#|=begin)"), "comment").otherwise("string")
        span = F.struct(F.greatest(start - F.col("mark"), F.lit(0)).alias("start"), (start + F.length(token) - F.col("mark")).alias("end"), kind.alias("kind"))
        return F.struct((start + F.length(token)).alias("at"), F.array_append(acc["out"], span).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))
    spans = F.when(F.size("found") == 0, empty["out"]).otherwise(F.aggregate(F.sequence(F.lit(0), F.size("found") - 1), empty, add)["out"])
    open_ = F.col("ends").isin(1, 2)
    quiet = F.when(here, F.transform("found", lambda t: F.repeat(F.lit(" "), F.length(t)))).otherwise(F.transform("found", lambda t, i: _blank(t, ~open_ | (i < F.size("found") - 1))))
    blanked = F.array_join(F.zip_with("between", quiet, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")
    code = F.when(F.size("found") == 0, F.col("text")).otherwise(F.substring(blanked, F.col("mark") + 1, F.length(blanked)))
    return x.select("file_key", "language", (F.col("at") + 1).alias("line"), "text", code.alias("code"), "begins", "ends", spans.alias("spans"))


def ignored_ranges(lines: DataFrame) -> DataFrame:
    """file_key, start_line, end_line, start_col, end_col, range_type of comments and strings; lines from 1, columns from 0.

    A span that begins where its line does and whose line begins in a text goes on from the line before; runs of these are one range.
    """
    x = lines.select("file_key", "line", "begins", F.posexplode(unfiltered(F.col("spans"))).alias("k", "span"))
    file = Window.partitionBy("file_key").orderBy("line", "k")
    begun = (F.col("begins") == 4) & (F.coalesce(F.lag("begins").over(file), F.lit(0)) != 4)  # a here document's first line
    x = x.withColumn("new", (F.col("k") > 0) | (F.col("begins") == 0) | begun)
    x = x.withColumn("range", F.sum(F.col("new").cast("int")).over(file))
    g = x.groupBy("file_key", "range").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min_by("span.start", "line").alias("start_col"), F.max_by("span.end", "line").alias("end_col"), F.min_by("span.kind", "line").alias("range_type"))
    return g.drop("range")


def read_status(files: DataFrame) -> DataFrame:
    """file_key, language, parse_success and parse_error of each file in a language that is read; only a missing content is not read."""
    x = files.select("file_key", structural_language(F.col("filename")).alias("language"), "content").where(F.col("language").isin(*LANGUAGES))
    return x.select("file_key", "language", F.col("content").isNotNull().alias("parse_success"), F.when(F.col("content").isNull(), "no content").alias("parse_error"))


def in_range(line: Column, col: Column) -> Column:
    """Whether a position lies in a range's columns start_line, start_col, end_line, end_col."""
    after = (line > F.col("start_line")) | ((line == F.col("start_line")) & (col >= F.col("start_col")))
    return after & ((line < F.col("end_line")) | ((line == F.col("end_line")) & (col <= F.col("end_col"))))


def inside_lines(line: Column) -> Column:
    """Whether a line lies strictly within a range of several lines."""
    return (F.col("end_line") > F.col("start_line")) & (line > F.col("start_line")) & (line < F.col("end_line"))
