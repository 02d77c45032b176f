"""Checked queries over lines: the line model, each rule, frames, whole files, directives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..functions.rules import RULE_IDS
from ..operators import file_rules, lines, neighbourhood, patch_rules, suppress
from . import derived

Query = Callable[[SparkSession, str], DataFrame]


def _t(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def hit(col: str, group: str) -> str:
    """A group's test in SQL."""
    return f"regexp_matches({col}, {_t(patterns.re2(group))})"


_HUNK = _t(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
# numbering, written with a self-contained count a hunk
NUMBERED_SQL = f"""
marked AS (
  SELECT *, CASE WHEN regexp_matches(raw, {_HUNK}) THEN '@' WHEN starts_with(raw, '---') OR starts_with(raw, '+++') THEN '#' WHEN starts_with(raw, '+') THEN '+' WHEN starts_with(raw, '-') THEN '-' ELSE ' ' END AS op FROM lines),
hunked AS (SELECT *, sum(CASE WHEN op = '@' THEN 1 ELSE 0 END) OVER (PARTITION BY file_key ORDER BY idx) AS hunk FROM marked),
numbered AS MATERIALIZED (
  SELECT file_key, filename, idx, raw, op, hunk, CASE WHEN op = '+' THEN substr(raw, 2) END AS body,
    CAST(coalesce(max(CASE WHEN op = '@' THEN CAST(regexp_extract(raw, {_HUNK}, 1) AS INT) END) OVER (PARTITION BY file_key, hunk), 0)
    + coalesce(sum(CASE WHEN op IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY file_key, hunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS new_line
  FROM hunked)"""

_FLAGS_SQL = {
    "error_handling": hit("raw", "error_handling"),
    "validation_lower": hit("lower(raw)", "validation"),
    "route_handler": hit("raw", "route_handler"),
    "loop": hit("raw", "loop"),
    "async": hit("raw", "async"),
    "pagination": hit("raw", "pagination"),
    "batching": hit("raw", "batching"),
    "request_context": f"({hit('raw', 'route_handler')} OR {hit('raw', 'request_use')})",
    "backoff_lower": hit("lower(raw)", "backoff"),
    "delay": hit("raw", "delay"),
    "act_added": f"(starts_with(raw, '+') AND {hit('raw', 'act')})",
    "io_added": f"(starts_with(raw, '+') AND {hit('raw', 'io')})",
    "io": hit("raw", "io"),
}


def frame_sql(name: str) -> str:
    flag, lo, hi = neighbourhood.FRAMES[name]
    side = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"
    return f"coalesce(bool_or(\"is_{flag}\") OVER (PARTITION BY file_key ORDER BY idx ROWS BETWEEN {side(lo)} AND {side(hi)}), false) AS {name}"


SPACES = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(65279)"


def around_sql(names) -> str:
    """CTEs up to around: numbered lines with these frames, and only the flags that they read."""
    names = [n for n in neighbourhood.FRAMES if n in set(names)]
    flags = [k for k in _FLAGS_SQL if k in {neighbourhood.FRAMES[n][0] for n in names}]
    return f"""
flagged AS MATERIALIZED (SELECT {", ".join(["*", *(f'{_FLAGS_SQL[k]} AS "is_{k}"' for k in flags)])} FROM numbered),
around AS MATERIALIZED (SELECT {", ".join(["*", *(frame_sql(n) for n in names)])} FROM flagged)"""


_TEST = "(contains(filename, '.test.') OR contains(filename, '.spec.') OR contains(filename, '__tests__'))"
_B = lambda g: hit("body", g)
# the block below a catch, up to where its braces are even, within ten lines; nothing but blank, comments or plain logging is silent
_AHEAD_SQL = """
opened AS (SELECT file_key, idx, list(raw) OVER (PARTITION BY file_key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM numbered),
depths AS (
  SELECT file_key, idx, ahead, list_transform(range(1, len(ahead) + 1), lambda k: list_sum(list_transform(ahead[1:k], lambda r: len(regexp_extract_all(r, '\\{')) - len(regexp_extract_all(r, '\\}'))))) AS depth
  FROM opened WHERE contains(ahead[1], 'catch')),
blocks AS (SELECT file_key, idx, trim(regexp_replace(array_to_string(ahead[2:coalesce(list_position(depth, 0), len(ahead))], chr(10)), '[{}]', '', 'g'), ' ' || chr(9) || chr(10)) AS block FROM depths),
silent AS MATERIALIZED (
  SELECT file_key, idx FROM blocks
  WHERE regexp_full_match(regexp_replace(block, '//[^\\n]*', '', 'g'), '\\s*')
    OR (regexp_full_match(block, '(\\s*console\\.(log|error|warn)\\([^)]*\\);\\s*)+') AND NOT regexp_matches(block, 'throw|return|reject')))"""
#: In report order: kind, severity, predicate.
RULES_SQL: list[tuple[str, str, str]] = [
    ("TEMPORARY_HACK", "'medium'", _B("hack")),
    ("UNSAFE_IO", "'high'", f"{_B('io')} AND NOT near_error_handling AND NOT after_loop"),
    ("CONSOLE_DEBUG", "'low'", f"NOT {_TEST} AND {_B('debug')}"),
    ("UNVALIDATED_INPUT", "'medium'", f"{_B('request_input')} AND in_route_handler AND NOT near_validation"),
    ("DATA_SHAPE_ASSUMPTION", "'medium'", _B("non_null")),
    ("DATA_SHAPE_ASSUMPTION", "'medium'", f"{_B('cast')} AND {_B('request_input')}"),
    ("LOOPED_IO", "'high'", f"{_B('io')} AND after_loop"),
    ("SILENT_ERROR", "CASE WHEN io_around THEN 'high' ELSE 'medium' END", "(file_key, idx) IN (SELECT (file_key, idx) FROM silent) AND contains(body, 'catch')"),
    ("ASYNC_MISUSE", "'medium'", "in_async AND contains(body, '.then(') AND NOT near_error_handling"),
    ("ASYNC_MISUSE", "'medium'", f"in_async AND {_B('async_call')} AND NOT {_B('async_handled')}"),
    ("UNBOUNDED_QUERY", "'high'", f"{_B('db_query')} AND NOT near_pagination"),
    ("UNBOUNDED_COLLECTION_PROCESSING", "'high'", f"{_B('collection')} AND in_request AND {_B('large_collection')}"),
    ("MISSING_BATCHING", "'high'", f"{_B('loop')} AND before_io AND NOT near_batching"),
    ("MEMORY_RISK", "'high'", f"{_B('memory')} AND NOT {_B('streaming_hint')}"),
    ("SHARED_FILE_WRITE", "'high'", f"{_B('file_write')} AND {_B('hardcoded_path')}"),
    ("RETRY_STORM_RISK", "'high'", f"{hit('lower(body)', 'retry')} AND {_B('io')} AND NOT near_backoff"),
    ("BUSY_WAIT_OR_TIGHT_LOOP", "'high'", f"{_B('tight_loop')} AND NOT before_delay"),
    ("CHECK_THEN_ACT_RACE", "'medium'", f"{_B('check')} AND before_act"),
    ("HARDCODED_SECRET", "'high'", _B("secret")),
    ("BLOCKING_OPERATION", "'medium'", f"NOT {_TEST} AND {_B('blocking')}"),
    ("STATEFUL_SERVICE", "'high'", _B("stateful")),
    ("PROTOTYPE_INFRA", "'high'", _B("prototype_infra")),
    ("UNSAFE_EVAL", "'high'", _B("unsafe_eval")),
    ("HARDCODED_URL", "'medium'", f"NOT {_TEST} AND {_B('hardcoded_url')}"),
]
_SHAPE = _t(r"(?:res\.(?:json|send)|return)\s*\(\s*\{([^}]*)\}")
_CALLS = [patterns.re2_member(m) for m in patterns.EXTERNAL_CALLS]
_SIG = "CASE " + " ".join(f"WHEN regexp_matches(body, {_t(c)}) THEN {i}" for i, c in enumerate(_CALLS)) + " END"
_HTTP = "CASE " + " ".join(f"WHEN regexp_matches(body, {_t(c)}) THEN {str('http' in (m if isinstance(m, str) else m[1])).lower()}" for c, m in zip(_CALLS, patterns.EXTERNAL_CALLS, strict=True)) + " END"
_BASE = f"WITH {derived.LINES_SQL}, {NUMBERED_SQL}"
_LOOKED_AT = f"looked_at AS MATERIALIZED (SELECT *, substr(trim(body, {SPACES}), 1, 100) AS trimmed FROM around WHERE op = '+' AND trim(body, {SPACES}) <> '')"
_MIXED = f"""
shapes AS (
  SELECT file_key, filename, idx, new_line AS line, list_sort(regexp_extract_all(regexp_extract(raw, {_SHAPE}, 1), '(\\w+)\\s*:', 1)) AS keys
  FROM numbered WHERE op = '+' AND regexp_matches(raw, {_SHAPE})),
mixed AS MATERIALIZED (
  SELECT a.file_key, a.filename, -1 AS idx, 0 AS rule_ord, a.line, 'medium' AS severity, 'MIXED_RESPONSE_SHAPES' AS kind, 'Shapes differ at lines ' || a.line || ' and ' || b.line AS snippet
  FROM shapes a JOIN shapes b ON a.file_key = b.file_key AND a.idx < b.idx AND len(a.keys) > 0 AND len(b.keys) > 0 AND a.keys <> b.keys
  QUALIFY row_number() OVER (PARTITION BY a.file_key ORDER BY a.idx, b.idx) = 1)"""


def _changed(seen: str) -> str:
    return f"""
decl AS (SELECT *, regexp_extract(raw, '^\\+(?:let|var|const)\\s+(\\w+)\\s*=', 1) AS name FROM {seen} WHERE {hit("raw", "top_level_mutable")}),
changed AS (
  SELECT DISTINCT d.file_key, d.filename, d.idx, 101 AS rule_ord, d.new_line AS line, 'high' AS severity, 'GLOBAL_MUTATION' AS kind, 'Variable ''' || name || ''' is mutated after declaration' AS snippet
  FROM decl d JOIN numbered l ON d.file_key = l.file_key AND l.idx > d.idx AND starts_with(l.raw, '+') AND contains(l.raw, name)
  WHERE regexp_matches(l.raw, name || '\\.push\\(') OR regexp_matches(l.raw, name || '\\[.+\\]\\s*=') OR regexp_matches(l.raw, name || '\\.\\w+\\s*=') OR regexp_matches(l.raw, name || '\\s*=\\s*'))""".replace("\\'\\'", "''")


def _repeated(seen: str) -> str:
    return f"""
calls AS (
  SELECT file_key, filename, idx, new_line AS line, trimmed AS snippet, {_HTTP} AS http, {_SIG} AS call,
    CASE WHEN regexp_matches(body, '["''`]([^"''`]+)["''`]') THEN regexp_extract(body, '["''`]([^"''`]+)["''`]', 1) ELSE ':' || substr(trim(body, {SPACES}), 1, 50) END AS rest
  FROM {seen}),
repeated AS (
  SELECT file_key, min_by(filename, idx) AS filename, min(idx) AS idx, 102 AS rule_ord, min_by(line, idx) AS line,
    CASE WHEN bool_or(http) OR contains(rest, 'http') OR contains(rest, 'api.') OR contains(rest, 'fetch(') THEN 'high' ELSE 'medium' END AS severity, 'NO_CACHING' AS kind, min_by(snippet, idx) AS snippet
  FROM calls WHERE call IS NOT NULL GROUP BY file_key, call, rest HAVING count(*) >= 2)"""


def rule_sql(kind: str) -> str:
    """One rule over all lines: only the flags and frames that it reads."""
    cols = ", ".join(COLUMNS)
    if kind == "MIXED_RESPONSE_SHAPES":
        return f"{_BASE}, {_MIXED} SELECT {cols} FROM mixed"
    rules = [(i + 1, s, p) for i, (k, s, p) in enumerate(RULES_SQL) if k == kind]
    frames = [n for n in neighbourhood.FRAMES if any(n in s or n in p for _, s, p in rules)]
    start = f"{_BASE}, {around_sql(frames)}, {_LOOKED_AT}" + (f", {_AHEAD_SQL}" if kind == "SILENT_ERROR" else "")
    if kind == "GLOBAL_MUTATION":
        return f"{start}, {_changed('looked_at')} SELECT {cols} FROM changed"
    if kind == "NO_CACHING":
        return f"{start}, {_repeated('looked_at')} SELECT {cols} FROM repeated"
    return start + " " + " UNION ALL ".join(f"SELECT file_key, filename, idx, {i} AS rule_ord, new_line AS line, {s} AS severity, '{kind}' AS kind, trimmed AS snippet FROM looked_at WHERE {p}" for i, s, p in rules)


def findings_sql(cap: int) -> str:
    """CTEs up to all_found (file_key, filename, idx, rule_ord, line, severity, kind, snippet), cap a file."""
    hits = ", ".join(f"CASE WHEN {p} THEN struct_pack(rule_ord := {i + 1}, severity := {s}, kind := '{k}') END" for i, (k, s, p) in enumerate(RULES_SQL))
    return f"""{_BASE}, {around_sql(neighbourhood.FRAMES)}, {_LOOKED_AT}, {_AHEAD_SQL},
tested AS MATERIALIZED (SELECT *, list_filter([{hits}], lambda h: h IS NOT NULL) AS hits FROM looked_at), {_MIXED},
summed AS (SELECT *, coalesce(sum(len(hits)) OVER (PARTITION BY file_key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tested),
seen AS MATERIALIZED (SELECT s.* FROM summed s LEFT JOIN mixed m ON s.file_key = m.file_key WHERE before + CASE WHEN m.kind IS NULL THEN 0 ELSE 1 END < {cap}),
line_found AS (SELECT file_key, filename, idx, new_line, trimmed, unnest(hits) AS h FROM seen), {_changed('seen')}, {_repeated('seen')},
first_found AS MATERIALIZED (
  SELECT file_key, filename, idx, rule_ord, line, severity, kind, snippet FROM mixed
  UNION ALL SELECT file_key, filename, idx, h.rule_ord, new_line, h.severity, h.kind, trimmed FROM line_found
  UNION ALL SELECT file_key, filename, idx, rule_ord, line, severity, kind, snippet FROM changed),
had_found AS (SELECT file_key, count(*) AS had FROM first_found GROUP BY 1),
cached AS (
  SELECT c.file_key, c.filename, c.idx, c.rule_ord, c.line, c.severity, c.kind, c.snippet
  FROM repeated c LEFT JOIN had_found h ON c.file_key = h.file_key
  QUALIFY coalesce(had, 0) + row_number() OVER (PARTITION BY c.file_key ORDER BY idx) <= {cap}),
all_found AS (SELECT * FROM first_found UNION ALL SELECT * FROM cached)"""


def found(spark: SparkSession, sf_dir: str, cap: int) -> DataFrame:
    return patch_rules.analyze_lines(derived.corpus_lines(spark, sf_dir), cap)


COLUMNS = ["file_key", "filename", "idx", "rule_ord", "line", "severity", "kind", "snippet"]


def _rule(kind: str) -> Query:
    return lambda spark, sf_dir: patch_rules.analyze_lines(derived.corpus_lines(spark, sf_dir), None, [kind]).select(*COLUMNS)


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"), F.lit("d").alias("filename"), F.col("text").alias("content"))
    return lines.content_lines(d).select(F.col("file_key").alias("doc_id"), "line_no", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def patch_new_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_new_lines(derived.corpus_lines(spark, sf_dir)).select("file_key", "idx", "op", F.col("hunk").cast("long").alias("hunk"), "new_line")


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.changed_lines(derived.corpus_lines(spark, sf_dir))


def added_text_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.added_text(derived.corpus_lines(spark, sf_dir))


def _frame(name: str) -> Query:
    return lambda spark, sf_dir: neighbourhood.with_neighbourhood(derived.corpus_lines(spark, sf_dir), [name]).select("file_key", "idx", name)


def full_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_rules.analyze_files(derived.corpus_files(spark, sf_dir)).select("file_key", "filename", "line", "kind", "severity", "snippet")


def secrets_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"), F.lit("d.txt").alias("filename"), F.col("text").alias("content"))
    return file_rules.analyze_files(d, ["HARDCODED_SECRET"]).select(F.col("file_key").alias("doc_id"), "line", "snippet")


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.redact(F.col("text"))
    return derived.read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def parse_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _directives(spark, sf_dir).select("file_key", "line", "scope", "all_rules", F.array_join("rules", ",").alias("rules"))


def _directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines.added_text(derived.corpus_lines(spark, sf_dir)).groupBy("file_key").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return suppress.parse_directives(t.select("file_key", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text")))


def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules, and one of an unknown kind and one without a line for each file."""
    src = derived.corpus_lines(spark, sf_dir)
    found = patch_rules.analyze_lines(src).select(*COLUMNS)
    more = src.where("idx = 0").select("file_key", "filename", "idx", F.lit(0).alias("rule_ord"), F.lit(1).alias("line"), F.lit("low").alias("severity"), F.lit("SCALING_RISK").alias("kind"), F.lit("").alias("snippet"))
    found = found.unionByName(more).unionByName(more.withColumns({"kind": F.lit("CONSOLE_DEBUG"), "line": F.lit(None).cast("int")}))
    return suppress.suppress(found, _directives(spark, sf_dir)).select(*COLUMNS)


def file_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.file_suppressions(_directives(spark, sf_dir)).withColumn("rules", F.array_join("rules", ","))


QUERIES: dict[str, Query] = {
    "lines_explode": lines_explode,
    "patch_new_line_numbers": patch_new_line_numbers,
    "changed_lines": changed_lines,
    "added_text_renumber": added_text_renumber,
    **{n: _frame(n) for n in neighbourhood.FRAMES},
    **{f"rule_{k.lower()}": _rule(k) for k in RULE_IDS},
    "findings_capped": lambda spark, sf_dir: found(spark, sf_dir, patch_rules.MAX_FINDINGS).select(*COLUMNS),
    "findings_capped_at_5": lambda spark, sf_dir: found(spark, sf_dir, 5).select(*COLUMNS),
    "full_file_scan": full_file_scan,
    "secrets_in_documents": secrets_in_documents,
    "redact_documents": redact_documents,
    "parse_directives": parse_directives,
    "suppressed_findings": suppressed_findings,
    "file_suppressions": file_suppressions,
}

_ADDED = """
added AS (
  SELECT file_key, idx, row_number() OVER (PARTITION BY file_key ORDER BY idx) AS line_no,
    CASE WHEN starts_with(raw, '+') THEN substr(raw, 2) ELSE raw END AS text
  FROM lines WHERE (starts_with(raw, '+') AND NOT starts_with(raw, '+++')) OR NOT (starts_with(raw, '-') OR starts_with(raw, '@@') OR starts_with(raw, 'diff ') OR starts_with(raw, '+')))"""
_SAID = ", ".join(f"({_t(text)}, '{scope}', {whole}, '{rules}')" for text, (scope, whole, rules) in derived.DIRECTIVES.items())
#: What the corpus' directives say, written out.
DIRECTIVES_SQL = f"""
said(words, scope, all_rules, rules) AS (VALUES {_SAID}),
directives AS MATERIALIZED (SELECT file_key, line_no AS line, scope, all_rules, rules FROM added JOIN said ON contains(text, words))"""
#: Whether a directive d covers a finding a of one of the rules.
COVERED_SQL = """(d.all_rules OR list_contains(string_split(d.rules, ','), a.kind))
  AND (d.scope = 'file' OR (d.scope = 'line' AND d.line = a.line) OR (d.scope = 'next-line' AND d.line + 1 = a.line))"""
_cols = ", ".join(COLUMNS)
_FILE_CHECKS = [("STATEFUL_SERVICE", "high", hit("t", "stateful")), ("PROTOTYPE_INFRA", "high", hit("t", "prototype_infra")), ("HARDCODED_SECRET", "high", f"{hit('t', 'secret')} AND NOT {_TEST}"), ("UNSAFE_EVAL", "high", hit("t", "unsafe_eval")), ("GLOBAL_MUTATION", "medium", hit("t", "module_literal"))]
_file_each = " UNION ALL ".join(f"SELECT file_key, filename, line, {i} AS o, '{k}' AS kind, '{s}' AS severity, " + (f"substr(trim(t, {SPACES}), 1, 80) || CASE WHEN length(t) > 80 THEN '...' ELSE '' END" if k == "HARDCODED_SECRET" else f"trim(t, {SPACES})") + f" AS snippet FROM content WHERE {p}" for i, (k, s, p) in enumerate(_FILE_CHECKS))
_redacted = "text"
for _m in patterns.GROUPS["secret"]:
    _redacted = f"regexp_replace({_redacted}, {_t(patterns.re2_member(_m))}, '{text.REDACTED}', 'g')"

SQL: dict[str, str] = {
    "lines_explode": "SELECT doc_id, CAST(p AS INT) AS line_no, length(ls[p]) AS n_chars, md5(ls[p]) AS digest FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
    "patch_new_line_numbers": f"{_BASE} SELECT file_key, idx, op, hunk, new_line FROM numbered",
    "changed_lines": f"{_BASE} SELECT DISTINCT file_key, new_line AS line FROM numbered WHERE op = '+'",
    "added_text_renumber": f"WITH {derived.LINES_SQL}, {_ADDED} SELECT file_key, idx, line_no, text FROM added",
    **{n: f"{_BASE}, {around_sql([n])} SELECT file_key, idx, {n} FROM around" for n in neighbourhood.FRAMES},
    **{f"rule_{k.lower()}": rule_sql(k) for k in RULE_IDS},
    "findings_capped": f"{findings_sql(50)} SELECT {_cols} FROM all_found",
    "findings_capped_at_5": f"{findings_sql(5)} SELECT {_cols} FROM all_found",
    "full_file_scan": f"WITH {derived.LINES_SQL}, content AS (SELECT file_key, filename, row_number() OVER (PARTITION BY file_key ORDER BY idx) AS line, substr(raw, 2) AS t FROM lines WHERE idx > 0 AND NOT starts_with(raw, '-')), hits AS ({_file_each}) SELECT file_key, filename, line, kind, severity, snippet FROM hits QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY line, o) <= 50",
    "secrets_in_documents": f"WITH l AS (SELECT doc_id, p AS line, ls[p] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) SELECT doc_id, line, substr(trim(t, {SPACES}), 1, 80) || CASE WHEN length(t) > 80 THEN '...' ELSE '' END AS snippet FROM l WHERE {hit('t', 'secret')} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 50",
    "redact_documents": f"SELECT doc_id, length(r) AS n_chars, md5(r) AS digest FROM (SELECT doc_id, {_redacted} AS r FROM documents)",
    "parse_directives": f"WITH {derived.LINES_SQL}, {_ADDED}, {DIRECTIVES_SQL} SELECT file_key, line, scope, all_rules, rules FROM directives",
    "file_suppressions": f"WITH {derived.LINES_SQL}, {_ADDED}, {DIRECTIVES_SQL} SELECT file_key, bool_or(all_rules) AS all_rules, coalesce(string_agg(DISTINCT nullif(rules, ''), ','), '') AS rules FROM directives WHERE scope = 'file' GROUP BY 1",
    "suppressed_findings": f"""{findings_sql(50)}, {_ADDED}, {DIRECTIVES_SQL},
every AS (
  SELECT * FROM all_found UNION ALL SELECT file_key, filename, 0, 0, 1, 'low', 'SCALING_RISK', '' FROM lines WHERE idx = 0
  UNION ALL SELECT file_key, filename, 0, 0, NULL, 'low', 'CONSOLE_DEBUG', '' FROM lines WHERE idx = 0)
SELECT {_cols} FROM every a WHERE a.line IS NULL
  OR (a.kind = 'SCALING_RISK' AND a.file_key NOT IN (SELECT file_key FROM directives WHERE scope = 'file' AND all_rules))
  OR (a.kind <> 'SCALING_RISK' AND NOT EXISTS (SELECT 1 FROM directives d WHERE d.file_key = a.file_key AND {COVERED_SQL}))""",
}
