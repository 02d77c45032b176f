"""Checked queries over the structure of written sources: comment and string ranges, what encloses each line, checks before acts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, source_lines
from ..sources.staging import staged
from . import derived
from .finding_queries import _FILES

Query = Callable[[SparkSession, str], DataFrame]


def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and strings of sources in which they run over lines."""
    return source_lines.ignored_ranges(source_lines.source_lines(derived.source_files(spark, sf_dir)))


def ignored_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and strings of the files that changes make."""
    return source_lines.ignored_ranges(source_lines.source_lines(derived.corpus_files(spark, sf_dir)))


def line_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_scopes(derived.source_files(spark, sf_dir)).drop("in_route")


def block_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as intervals of places, in the file's length if nothing closes them."""
    lines = staged(blocks.placed(source_lines.source_lines(derived.source_files(spark, sf_dir))), "lines")
    x = blocks.blocks(lines, blocks.brackets(lines))
    return x.select("file_key", "line", "open", F.when(F.col("close") < blocks.END, F.col("close")).alias("close"), "kind", "async", "name")


def checks_then_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = staged(blocks.placed(source_lines.source_lines(derived.source_files(spark, sf_dir))), "lines")
    marks = staged(blocks.brackets(lines), "marks")
    return blocks.checks_then_acts(marks, blocks.statements(lines, marks)).select("file_key", "line", "act_line")


QUERIES: dict[str, Query] = {f.__name__: f for f in (source_ranges, ignored_ranges, line_scopes, block_intervals, checks_then_acts)}

# The definition by whole contents: tokens by one expression for each family, then places by character.
_STRINGS = r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?"""
_PATTERNS = {
    1: r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|" + _STRINGS + r"|`(?:\\.|[^`\\])*`?",
    2: r'(?s)#[^\n]*|""".*?(?:"""|\z)|' + r"'''.*?(?:'''|\z)|" + _STRINGS,
    3: r"(?sm)^=begin.*?(?:^=end[^\n]*|\z)|#[^\n]*|" + r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?""",
}
_q = lambda s: "'" + s.replace("'", "''") + "'"
_family = lambda name: f"CASE WHEN regexp_matches({name}, '\\.(ts|js|go)$') THEN 1 WHEN {name} LIKE '%.py' THEN 2 WHEN {name} LIKE '%.rb' THEN 3 END"
TOKENS_SQL = (
    """
pieces AS MATERIALIZED ("""
    + " UNION ALL ".join(f"SELECT file_key, content, regexp_extract_all(content, {_q(p)}) AS ts, regexp_split_to_array(content, {_q(p)}) AS ps FROM sources WHERE family = {k}" for k, p in _PATTERNS.items())
    + r"""),
counted AS (SELECT file_key, content, unnest(range(1, len(ts) + 1)) AS i, ts, ps FROM pieces),
tokens AS MATERIALIZED (
  SELECT file_key, content, ts[i] AS t, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ts[1:i - 1], lambda x: length(x))), 0)::BIGINT AS a FROM counted)"""
)
RANGES_SQL = r"""
SELECT file_key, 1 + length(left(content, a)) - length(replace(left(content, a), chr(10), '')) AS start_line,
  1 + length(left(content, a + length(t))) - length(replace(left(content, a + length(t)), chr(10), '')) AS end_line,
  length(regexp_extract(left(content, a), '[^\n]*\z')) AS start_col, length(regexp_extract(left(content, a + length(t)), '[^\n]*\z')) AS end_col,
  CASE WHEN regexp_matches(t, '^(//|/\*|#|=begin)') THEN 'comment' ELSE 'string' END AS range_type
FROM tokens"""


def _told(rows: list[tuple], family: int) -> str:
    return ", ".join(f"({family}, {k + 1}, {_q(kind)}, {str(is_async).lower()}, {_q(name)})" for k, (_, kind, is_async, name) in enumerate(rows) if kind)


_go = lambda kind: kind if kind == "loop" else "block"
#: What each line opens; family 0 is Go, to which most of these heads mean nothing. while is no word of it.
_TOLD = ", ".join([
    _told(derived.BRACE_LINES, 1), _told([(t, k and ("loop" if t.lstrip().startswith("for") else "block"), False, "") for t, k, _, _ in derived.BRACE_LINES], 0),
    _told(derived.PYTHON_LINES, 2), _told(derived.RUBY_LINES, 3),
])
#: Places are characters from the start; pairs come from depths by a join over ranges, and so does what encloses a line.
BLOCKS_SQL = rf"""
told(family, slot, kind, is_async, name) AS (VALUES {_TOLD}),
rows AS MATERIALIZED (
  SELECT l.file_key, l.line, l.slot, CASE WHEN l.file_key % 5 = 2 THEN 0 ELSE l.family END AS family, CASE l.family WHEN 1 THEN ({derived.sql_texts(derived.BRACE_LINES)})[slot] WHEN 2 THEN ({derived.sql_texts(derived.PYTHON_LINES)})[slot] ELSE ({derived.sql_texts(derived.RUBY_LINES)})[slot] END AS body FROM source_lines l),
at_rows AS MATERIALIZED (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY file_key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM rows),
chars AS (SELECT file_key, line, slot, family, pos + k - 1 AS pos, body[k] AS ch FROM (SELECT *, unnest(range(1, length(body) + 1)) AS k FROM at_rows)),
hidden AS (SELECT file_key, a, a + length(t) AS b FROM tokens),
-- characters of code that are not blank
seen AS MATERIALIZED (SELECT * FROM chars c WHERE ch <> ' ' AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.file_key = c.file_key AND c.pos >= h.a AND c.pos < h.b)),
-- strings show where they begin and where they end
quotes AS (SELECT file_key, a, t, regexp_extract(t, '^("{{3}}|''{{3}}|["''`])') AS q FROM tokens),
ends AS (SELECT file_key, a AS pos FROM quotes WHERE q <> '' UNION SELECT file_key, a + length(t) - 1 FROM quotes WHERE q <> '' AND length(t) >= 2 * length(q) AND right(t, length(q)) = q),
shown AS MATERIALIZED (SELECT file_key, line, slot, family, pos, ch FROM seen UNION ALL SELECT c.file_key, c.line, c.slot, c.family, c.pos, '"' FROM chars c JOIN ends e ON e.file_key = c.file_key AND e.pos = c.pos),
marks AS MATERIALIZED (
  SELECT *, sum(CASE WHEN ch IN ('{{', '(') THEN 1 ELSE -1 END) OVER (PARTITION BY file_key, ch IN ('{{', '}}') ORDER BY pos) AS depth FROM seen WHERE ch IN ('{{', '}}', '(', ')')),
pairs AS MATERIALIZED (
  SELECT o.file_key, o.line, o.slot, o.family, o.ch, o.pos AS a, min(c.pos) AS b FROM marks o LEFT JOIN marks c ON c.file_key = o.file_key AND c.ch = CASE o.ch WHEN '{{' THEN '}}' ELSE ')' END AND c.depth = o.depth - 1 AND c.pos > o.pos
  WHERE o.ch IN ('{{', '(') GROUP BY ALL),
firsts AS MATERIALIZED (SELECT file_key, line, any_value(slot) AS slot, any_value(family) AS family, min(pos) AS pos, min(pos) - min(start) AS indent, min(start) AS start FROM shown JOIN (SELECT file_key, line, pos AS start FROM at_rows) s USING (file_key, line) GROUP BY 1, 2),
-- lines of Python that begin in no text
logical AS (SELECT f.* FROM firsts f WHERE family = 2 AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.file_key = f.file_key AND h.a < f.start AND f.start < h.b)),
words AS MATERIALIZED (
  SELECT f.*, t.kind, t.is_async, t.name, sum(CASE WHEN t.kind = 'end' THEN -1 ELSE 1 END) OVER (PARTITION BY f.file_key ORDER BY f.line) AS depth
  FROM firsts f JOIN told t ON t.family = 3 AND t.slot = f.slot WHERE f.family = 3 AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.file_key = f.file_key AND h.a < f.start AND f.start < h.b)),
blocks AS MATERIALIZED (
  SELECT p.file_key, p.line, p.a AS open, p.b AS close, t.kind, t.is_async, t.name FROM pairs p JOIN told t ON t.family = p.family AND t.slot = p.slot WHERE p.ch = '{{' AND p.family < 2
  UNION ALL SELECT f.file_key, f.line, f.pos, min(n.start) - 1, t.kind, t.is_async, t.name FROM logical f JOIN told t ON t.family = 2 AND t.slot = f.slot
    LEFT JOIN logical n ON n.file_key = f.file_key AND n.line > f.line AND n.indent <= f.indent GROUP BY ALL
  UNION ALL SELECT o.file_key, o.line, o.pos, min(c.start) - 1, o.kind, o.is_async, o.name FROM words o LEFT JOIN words c ON c.file_key = o.file_key AND c.kind = 'end' AND c.depth = o.depth - 1 AND c.line > o.line
    WHERE o.kind <> 'end' GROUP BY ALL)"""
SCOPES_SQL = r"""
scopes AS MATERIALIZED (
  SELECT file_key, open, coalesce(close, 1::BIGINT << 60) AS close, kind, is_async, name FROM blocks
  -- heads of for and while, and the arguments of forEach
  UNION ALL SELECT file_key, a, coalesce(b, 1::BIGINT << 60), 'loop', false, '' FROM pairs p WHERE ch = '(' AND family = 1 AND slot IN (2, 8, 21) AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.file_key = p.file_key AND q.line = p.line AND q.ch = '(' AND q.a < p.a)),
met AS (
  SELECT f.file_key, f.line, f.pos, s.open, s.kind, s.is_async, s.name FROM firsts f JOIN scopes s ON s.file_key = f.file_key AND s.open < f.pos AND f.pos <= s.close)
SELECT f.file_key, f.line, count(*) FILTER (kind = 'func') > 0 AS in_function, count(*) FILTER (kind = 'loop') > 0 AS in_loop, count(*) FILTER (kind = 'try') > 0 AS in_try,
  coalesce(max_by(is_async, open) FILTER (kind = 'func'), false) AS in_async, count(*) FILTER (kind IN ('func', 'class')) = 0 AS module_scope,
  max_by(name, open) FILTER (kind = 'func' AND name <> '') AS parent_fn, max_by(name, open) FILTER (kind = 'class') AS class_name
FROM firsts f LEFT JOIN met USING (file_key, line) GROUP BY f.file_key, f.line"""
# Lines of the sources are statements, or go on with one: what they begin with and what the line before ends with tell.
RACES_SQL = r"""
codes AS MATERIALIZED (SELECT file_key, line, min(pos) AS pos, string_agg(ch, '' ORDER BY pos) AS code FROM shown WHERE family = 1 AND file_key % 5 < 2 GROUP BY 1, 2),
braces AS MATERIALIZED (SELECT file_key, a, coalesce(b, 1::BIGINT << 60) AS b, ch FROM pairs WHERE family = 1),
begun AS (
  SELECT *, CASE WHEN before IS NULL OR before IN ('{', ';') THEN NOT starts_with(code, '}') WHEN before = '}' THEN NOT regexp_matches(code, '^[)\],.;(}?]|^(catch|else|finally)') ELSE regexp_matches(code, '^[\w$"@]') AND regexp_matches(before, '[\w$)\]"+-]') END AS ok
  FROM (SELECT *, right(lag(code) OVER (PARTITION BY file_key ORDER BY line), 1) AS before FROM codes)),
inner_block AS (SELECT g.file_key, g.pos, max(s.a) AS block FROM begun g JOIN braces s ON s.file_key = g.file_key AND s.ch = '{' AND s.a < g.pos AND g.pos <= s.b WHERE ok GROUP BY 1, 2),
steps AS MATERIALIZED (
  SELECT file_key, pos, block, row_number() OVER (PARTITION BY file_key, block ORDER BY pos) AS ord FROM inner_block i
  WHERE NOT EXISTS (SELECT 1 FROM braces s WHERE s.file_key = i.file_key AND s.ch = '(' AND s.a > i.block AND s.a < i.pos AND i.pos <= s.b)),
calls AS (SELECT p.file_key, p.line, p.slot, p.a AS pos, s.a AS block FROM pairs p JOIN braces s ON s.file_key = p.file_key AND s.ch = '{' AND s.a < p.a AND p.a <= s.b WHERE p.ch = '(' AND p.family = 1 AND p.file_key % 5 < 2 AND p.slot IN (15, 16)),
own AS (SELECT c.file_key, c.line, c.slot, c.pos, c.block, max(t.ord) AS ord FROM calls c JOIN steps t ON t.file_key = c.file_key AND t.block = c.block AND t.pos <= c.pos GROUP BY ALL),
acts AS (SELECT file_key, block, ord, min(pos) AS pos, min_by(line, pos) AS line FROM own WHERE slot = 16 GROUP BY 1, 2, 3),
checks AS (SELECT * FROM own o WHERE slot = 15 AND block = (SELECT max(block) FROM calls c WHERE c.file_key = o.file_key AND c.pos = o.pos))
SELECT c.file_key, c.line, a.line AS act_line FROM checks c JOIN acts a ON a.file_key = c.file_key AND a.block = c.block AND a.ord BETWEEN c.ord + 1 AND c.ord + 4"""
_WITH = f"WITH {derived.SOURCES_SQL}, {TOKENS_SQL}"
SQL: dict[str, str] = {
    "source_ranges": f"{_WITH} {RANGES_SQL}",
    "ignored_ranges": f"{_FILES}, sources AS (SELECT file_key, content, {_family('filename')} AS family FROM files), {TOKENS_SQL} {RANGES_SQL}",
    "block_intervals": f'{_WITH}, {BLOCKS_SQL} SELECT file_key, line, open, close, kind, is_async AS "async", name FROM blocks',
    "line_scopes": f"{_WITH}, {BLOCKS_SQL}, {SCOPES_SQL}",
    "checks_then_acts": f"{_WITH}, {BLOCKS_SQL}, {RACES_SQL}",
}
