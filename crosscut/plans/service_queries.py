"""Checked queries over scans, prompts, deliveries and what else surrounds the analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rules import COMPLEX_RULES, RULE_IDS
from ..operators import group, lines, outline, report, review_answers, score, service, source_lines, structural_rules
from ..sources import repo_config, scans
from ..sources.staging import staged
from . import analyses, derived, snippets
from .finding_queries import _FILES, _N, _NAME, _ORD, _VALID, _answers, _score_sql, _sql_list, _snapshots, n_, valid_once

Query = Callable[[SparkSession, str], DataFrame]
SECRET = "a shared secret"
BASE = "rules:\n  UNSAFE_IO: {level: info}\nscoring: {high_risk_score: 40}\n"
ERRORS = ["Network down", "ETIMEDOUT timeout", "bad request", "HTTP 429", "not found", "socket hang up", "503 unavailable", ""]
TEXTS = ["x_test.go", "spec/x_spec.rb", "lib/a_test.rb", "main.go"]


def _change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change sets of a few files each, and one of every tenth file."""
    pr = F.when(F.col("file_key") % 10 == 0, 0).otherwise(F.col("file_key") % 400)
    return derived.corpus_files(spark, sf_dir).select(pr.cast("long").alias("pr_id"), F.col("file_key").cast("int").alias("file_ord"), "filename")


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hook reads of change sets: the first 50 files."""
    return scans.pr_files(_change_sets(spark, sf_dir))


def api_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the API reads of change sets, and of which of these files it reads the whole content."""
    x = scans.pr_files(_change_sets(spark, sf_dir), scans.API_FILES)
    whole = scans.pr_files(x, scans.API_CONTENT_FILES).select("pr_id", "file_ord", F.lit(True).alias("with_content"))
    return x.join(whole, ["pr_id", "file_ord"], "left").na.fill(False, ["with_content"])


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.read(spark, sf_dir, "documents").where("text is not null")
    kind = F.when(F.col("doc_id") % 7 == 0, "dir").otherwise("file")
    x = scans.decoded_content(d.select("doc_id", kind.alias("kind"), F.octet_length("text").cast("long").alias("size"), F.base64(F.encode("text", "UTF-8")).alias("encoded")))
    return x.select("doc_id", F.md5("content").alias("digest"))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, head, base): a repository for each customer, with a configuration of its own at the head, the base, both or neither, or one that cannot be read."""
    k = F.col("c_custkey")
    rule = lambda n: F.element_at(F.array(*map(F.lit, RULE_IDS)), ((k + n) % 25 + 1).cast("int"))
    own = F.concat(
        F.lit("scoring: {high_risk_score: "), (k % 50 + 10).cast("string"), F.lit("}\nfiles: {ignore: ['src/f"), (k % 20).cast("string"), F.lit(".ts'], prototype_zone: ['src/*"), (k % 10).cast("string"),
        F.lit(".ts', 'lib/**']}\nrules:\n  "), rule(0), F.lit(": {level: "), F.when(k % 3 == 0, "info").when(k % 3 == 1, "off").otherwise("warning"), F.lit("}\noverrides:\n- patterns: ['src/f"), (k % 20).cast("string"),
        F.lit(".ts', '**/f7.ts']\n  rules: {"), rule(1), F.lit(": {level: info}, "), rule(0), F.lit(": {enabled: "), F.when(k % 4 == 0, "false").otherwise("true"), F.lit("}}\n- patterns: ['src/*"), (k % 10).cast("string"),
        F.lit(".ts']\n  rules: {"), rule(1), F.lit(": {level: error}}\n"),
    )
    case = k % 6
    head = F.when(case.isin(0, 2), own).when(case == 4, "a: [").when(case == 5, "- a")
    return derived.read(spark, sf_dir, "customer").select(k.alias("repo"), head.alias("head"), F.when(case == 1, own).when(case.isin(2, 4), BASE).alias("base"))


def config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in force in each repository: its threshold, globs, and rules that it names."""
    e = staged(repo_config.config_entries(_configs(spark, sf_dir)), "entries")
    n = lambda part: F.count_if(F.col("part") == part)
    return repo_config.scalars(e).join(e.groupBy("repo").agg(n("ignore").alias("n_ignored"), n("rule").alias("n_rules"), n("override").alias("n_overrides")), "repo")


def repo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, each by the configuration of its own repository."""
    repos, e = repo_config.shared_entries(_configs(spark, sf_dir))
    f = staged(n_(spark, sf_dir).select("pr_id", F.col("pr_id").alias("repo"), "seq", "kind", "file"), "findings")
    return repo_config.apply_repo_rules(f, e, "file", repos).select("pr_id", "seq", "kind", "file", "level", "is_prototype_zone")


def repo_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of change sets that their own repository leaves out."""
    e = repo_config.config_entries(_configs(spark, sf_dir))
    return repo_config.matched_paths(n_(spark, sf_dir).select(F.col("pr_id").alias("repo"), F.col("file").alias("path")), e, "ignore")


def api_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    r = o.select(k.alias("request"), F.when(k % 11 != 0, F.concat(F.lit("o"), (F.col("o_custkey") % 40).cast("string"))).alias("owner"), F.when(k % 13 == 0, "").otherwise("r").alias("repo"), (k % 50 - 1).cast("int").alias("pull_number"))
    i = spark.createDataFrame([(f"o{n}", "r", n + 1) for n in range(0, 40, 2)], "owner string, repo string, installation_id int")
    return scans.with_installation(scans.checked_requests(r), i).select("request", "error", "installation_id")


def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole patches split again; every ninth file has none, or a blank one."""
    src = derived.corpus_lines(spark, sf_dir)
    p = src.groupBy("file_key", "filename").agg(F.sort_array(F.collect_list(F.struct("idx", "raw"))).alias("l"))
    patch = F.array_join(F.transform("l", lambda s: s["raw"]), "\n")
    p = p.select("file_key", "filename", F.when(F.col("file_key") % 18 == 0, " \n ").when(F.col("file_key") % 9 != 0, patch).alias("patch"))
    return lines.patch_lines(p).select("file_key", F.col("idx").cast("int").alias("idx"), "raw")


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.truncate(F.col("text"))
    return derived.read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def test_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return derived.read(spark, sf_dir, "part").select("p_partkey", X.is_go_test(name).alias("go"), X.is_ruby_test(name).alias("ruby"), X.is_review_file(name).alias("code"))


def valid_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = n_(spark, sf_dir).withColumn("name", F.when(F.col("seq") % 3 == 0, F.lower("kind")).when(F.col("seq") % 3 == 1, F.col("kind")).otherwise("SCALING_RISK"))
    return f.groupBy("name").agg(F.count("*").alias("n")).withColumn("valid", F.col("name").isin(RULE_IDS))


def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_(spark, sf_dir).where("confidence is not null").select("pr_id", "seq", report.confidence_label(F.col("confidence")).alias("label"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of up to 4,000 characters for each file of a change set."""
    f = n_(spark, sf_dir).select("pr_id", "file").distinct()
    return f.withColumn("content", F.expr("repeat(concat(file, ' '), cast(pr_id % 400 as int))"))


def validation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = report.validation_prompts(n_(spark, sf_dir), _contents(spark, sf_dir))
    return x.select("pr_id", "file", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("digest"))


def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _contents(spark, sf_dir).select("pr_id", "file", F.when(F.col("pr_id") % 2 == 0, X.language_label(F.col("file"))).alias("language"), F.lit("+ x").alias("snippet"), F.when(F.col("pr_id") % 3 == 0, F.col("content")).alias("content"))
    found = n_(spark, sf_dir).where("pr_id % 5 <> 0 and line is not null")
    x = report.review_prompts(f, found, f.where("pr_id % 7 = 0").select("pr_id", "file", F.lit("1 import").alias("outline")))
    return x.select("pr_id", "file", "prompt")


def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = n_(spark, sf_dir)
    return report.summary_prompts(score.scores(f), score.severity_counts(f), group.summary_input(f)).select("pr_id", "prompt")


def job_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.job_outputs(valid_once(spark, sf_dir))


def issues_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = review_answers.issues(_answers(spark, sf_dir)).withColumn("batch", F.col("event_id") % 50).withColumn("ord", F.col("event_id") * 10 + F.col("ord"))
    x = group.issues_by_kind(i.select("batch", "ord", "kind", "title"), ("batch",))
    return x.select("batch", "kind", "count", "rank", F.array_join(F.transform("issues", lambda s: s["title"]), ",").alias("titles"))


def model_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that each tier of model validates in a change set, and the one summary of it."""
    f = n_(spark, sf_dir)
    tiers = f.groupBy("pr_id", service.model_tier(F.col("kind")).alias("tier")).agg(F.count("*").alias("n"))
    return tiers.unionByName(f.select("pr_id").distinct().select("pr_id", F.lit(service.TIERS["summary"]).alias("tier"), F.lit(1).cast("long").alias("n")))


def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each failed attempt is made again."""
    k = F.col("event_id")
    error = F.element_at(F.array(*map(F.lit, ERRORS)), (k % 8 + 1).cast("int"))
    return derived.read(spark, sf_dir, "events").select("event_id", X.is_transient_error(error).alias("transient"), service.retry_delay(k % 5, error, (k % 10) / 10).cast("long").alias("delay_ms"))


def webhook_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with their own signature, another's, or none."""
    e = derived.read(spark, sf_dir, "events").where("props is not null")
    k = F.col("event_id")
    made = F.when(k % 3 == 0, service.signature(F.col("props"), SECRET)).when(k % 3 == 1, service.signature(F.col("props"), "another"))
    x = service.verified(e.select("event_id", F.col("props").alias("payload"), made.alias("signature")), SECRET)
    return x.select("event_id", "valid", F.col("signature"))


def request_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook = F.col("event_type") == "click"
    return derived.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(service.timed_out(F.col("value") * 1000, hook)).alias("timed_out"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.read(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), F.col("event_type").alias("message"), "event_id", "user_id")
    return service.log_lines(e).select("event_id", F.col("line")).unionByName(service.log_lines(e, as_json=False).select((-F.col("event_id") - 1).alias("event_id"), "line"))


def positions_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions beside ranges of one or several lines: whether they lie in them, and whether their whole line does."""
    k = F.col("p_partkey")
    r = derived.read(spark, sf_dir, "part").select("p_partkey", (k % 9 + 1).cast("int").alias("start_line"), (k % 5).cast("int").alias("start_col"), (k % 9 + 1 + k % 3).cast("int").alias("end_line"), (k % 7 + 1).cast("int").alias("end_col"), (k % 11 + 1).cast("int").alias("line"), (k % 8).cast("int").alias("col"))
    return r.select("p_partkey", source_lines.in_range(F.col("line"), F.col("col")).alias("inside"), source_lines.inside_lines(F.col("line")).alias("whole_line"))


def tree_of_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a baseline scan reads of each repository's tree."""
    return scans.tree_filter(_snapshots(spark, sf_dir)).groupBy("repo").agg(F.count("*").alias("files"), F.sum("size").alias("chars"))


def _written(spark: SparkSession, sf_dir: str, table: list[tuple]) -> DataFrame:
    """One of the written sources for each part."""
    rows = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(table)], "k long, filename string, content string")
    p = derived.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_key"), (F.col("p_partkey") % len(table)).alias("k"))
    return p.join(F.broadcast(rows), "k").select("file_key", "filename", "content")


def ast_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural_rules.analyze_structure(_written(spark, sf_dir, snippets.SNIPPETS)).select("file_key", "line", "kind")


def ast_snippet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_lines.read_status(_written(spark, sf_dir, snippets.SNIPPETS)).select("file_key", "language", "parse_success")


def hybrid_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural findings of added lines only: each source as a patch of which the odd lines are new."""
    files = _written(spark, sf_dir, snippets.SNIPPETS)
    changed = lines.content_lines(files).where("line_no % 2 = 1").select("file_key", F.col("line_no").alias("line"))
    return structural_rules.analyze_structure(files, changed).select("file_key", "line", "kind")


def ignored_range_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_lines.ignored_ranges(source_lines.source_lines(_written(spark, sf_dir, snippets.RANGES))).select("file_key", "range_type", "start_line", "end_line")


def outline_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.outline(_written(spark, sf_dir, snippets.OUTLINES))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    pr_files, api_files, file_contents, config_resolution, repo_rules, repo_ignored, api_requests, patch_lines, truncated_texts, test_file_names, valid_rule_ids, confidence_labels, validation_prompts, review_prompts,
    summary_prompts, job_outputs, issues_by_kind, model_tiers, transient_errors, webhook_signatures, request_timeouts, log_lines, positions_in_ranges, tree_of_snapshots,
    ast_snippets, ast_snippet_status, hybrid_snippets, ignored_range_snippets, outline_snippets,
)}

_q = lambda s: "'" + s.replace("'", "''") + "'"


def _hmac(text: str, secret: str) -> str:
    """The definition, with the padded keys written out."""
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(k ^ b for k in key).hex() for b in (0x36, 0x5C))
    return f"'sha256=' || sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


_CONTENTS = "texts AS (SELECT DISTINCT pr_id, file, repeat(file || ' ', (pr_id % 400)::INT) AS content FROM findings)"
_PLACE = "'`' || file || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END || '`'"
#: Cases 0 and 2 have their own configuration at the head, 1 at the base; what is at the head stands even if it cannot be read.
_REPOS = "repos AS (SELECT c_custkey AS repo, c_custkey % 6 IN (0, 1, 2) AS own, false AS based FROM customer)"
_IDS = "[" + ", ".join(_q(r) for r in RULE_IDS) + "]"
_SET = "CASE WHEN file_key % 10 = 0 THEN 0 ELSE file_key % 400 END"
SQL: dict[str, str] = {
    "pr_files": f"{_FILES} SELECT {_SET} AS pr_id, file_key::INT AS file_ord, filename FROM files QUALIFY row_number() OVER (PARTITION BY {_SET} ORDER BY file_key) <= 50",
    "api_files": f"{_FILES}, n AS (SELECT {_SET} AS pr_id, file_key::INT AS file_ord, filename, row_number() OVER (PARTITION BY {_SET} ORDER BY file_key) AS n FROM files) SELECT pr_id, file_ord, filename, n <= 20 AS with_content FROM n WHERE n <= 100",
    "file_contents": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND octet_length(encode(text)) <= 51200 AND text <> '' THEN md5(text) END AS digest FROM documents WHERE text IS NOT NULL",
    "config_resolution": f"""
WITH {_REPOS} SELECT repo, CASE WHEN own THEN repo % 50 + 10 WHEN based THEN 40 ELSE 60 END::INT AS high_risk_below, 1.0::DOUBLE AS weight_multiplier, own::BIGINT AS n_ignored,
  CASE WHEN own OR based THEN 1 ELSE 0 END::BIGINT AS n_rules, CASE WHEN own THEN 5 ELSE 0 END::BIGINT AS n_overrides FROM repos""",
    "repo_ignored": f"{_N}, {_REPOS} SELECT DISTINCT repo, file AS path FROM findings JOIN repos ON pr_id = repo AND own WHERE file = 'src/f' || repo % 20 || '.ts'",
    "repo_rules": f"""{_N}, {_REPOS},
x AS (SELECT f.* EXCLUDE (level), level AS default_level, own, based, repo, kind = ({_IDS})[repo % 25 + 1] AS first, kind = ({_IDS})[(repo + 1) % 25 + 1] AS second, file IN ('src/f' || repo % 20 || '.ts', 'src/f7.ts') AS named, regexp_extract(file, '([0-9])\\.ts$', 1) = (repo % 10)::VARCHAR AS ends FROM findings f JOIN repos ON pr_id = repo),
y AS (
  SELECT *, CASE WHEN own AND second AND ends THEN 'error' WHEN own AND second AND named THEN 'info' WHEN own AND first THEN CASE repo % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'off' ELSE 'warning' END
    WHEN based AND kind = 'UNSAFE_IO' THEN 'info' ELSE default_level END AS level, NOT (own AND first AND named AND repo % 4 = 0) AS enabled FROM x)
SELECT pr_id, seq, kind, file, level, own AND ends AS is_prototype_zone FROM y WHERE enabled AND level <> 'off'""",
    "api_requests": """
WITH r AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 40 END AS n, o_orderkey % 13 = 0 AS empty_repo, o_orderkey % 50 - 1 AS pull FROM orders)
SELECT request, CASE WHEN n IS NULL THEN 'owner is required' WHEN empty_repo THEN 'repo is required' WHEN pull <= 0 THEN 'pull_number must be positive' WHEN n % 2 = 1 THEN 'not installed' END AS error,
  CASE WHEN n % 2 = 0 AND NOT empty_repo THEN n + 1 END AS installation_id FROM r""",
    "patch_lines": f"WITH {derived.LINES_SQL} SELECT file_key, idx::INT AS idx, raw FROM lines WHERE file_key % 9 <> 0",
    "truncated_texts": "WITH t AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '... [truncated]' ELSE text END AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM t",
    "test_file_names": "SELECT p_partkey, p_partkey % 4 = 0 AS go, p_partkey % 4 IN (1, 2) AS ruby, true AS code FROM part",
    "valid_rule_ids": f"{_N}, n AS (SELECT CASE seq % 3 WHEN 0 THEN lower(kind) WHEN 1 THEN kind ELSE 'SCALING_RISK' END AS name FROM findings) SELECT name, count(*) AS n, name IN {_sql_list(RULE_IDS)} AS valid FROM n GROUP BY name",
    "confidence_labels": f"{_N} SELECT pr_id, seq, CASE WHEN confidence >= 0.9 THEN 'very high' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM findings WHERE confidence IS NOT NULL",
    "validation_prompts": f"""{_N}, {_CONTENTS},
f AS (SELECT pr_id, file, list('- ' || kind || ' at ' || coalesce(line, 0) || ': ' || message ORDER BY seq) AS l FROM findings GROUP BY 1, 2),
p AS (SELECT pr_id, file, 'Say for each finding whether it is real.' || chr(10) || array_to_string(l[1:50], chr(10)) || chr(10) || chr(10) || 'Code:' || chr(10) || substr(content, 1, 3000) AS prompt FROM f JOIN texts USING (pr_id, file))
SELECT pr_id, file, length(prompt) AS n_chars, md5(prompt) AS digest FROM p""",
    "review_prompts": f"""{_N}, {_CONTENTS},
f AS (SELECT pr_id, file, list('{{"kind":"' || kind || '","line":' || line || ',"severity":"' || severity || '","summary":"' || message || '"}}' ORDER BY seq) AS l FROM findings WHERE pr_id % 5 <> 0 AND line IS NOT NULL GROUP BY 1, 2)
SELECT pr_id, file, concat_ws(chr(10) || chr(10), 'File: ' || file || CASE WHEN pr_id % 2 = 0 THEN ' (TypeScript)' ELSE '' END, CASE WHEN pr_id % 7 = 0 THEN 'Outline:' || chr(10) || '1 import' END,
  'Findings so far, one a line:' || chr(10) || array_to_string(l[1:50], chr(10)), CASE WHEN pr_id % 3 = 0 THEN 'Whole file:' || chr(10) || content END, 'Changed lines:' || chr(10) || '+ x', {_q(report.REVIEW_TASK)}) AS prompt
FROM texts LEFT JOIN f USING (pr_id, file)""",
    "summary_prompts": f"""{_N}, {_score_sql('findings', 'pr_id')},
c AS (SELECT pr_id, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM findings GROUP BY 1),
a AS (SELECT pr_id, kind, file, count(*) AS n, max({_ORD}) AS o, min(seq) AS q FROM findings GROUP BY 1, 2, 3),
k AS (SELECT pr_id, kind, sum(n)::BIGINT AS n, {_NAME('max(o)')} AS s, list(file ORDER BY q) AS files FROM a GROUP BY 1, 2),
t AS (SELECT pr_id, string_agg('- ' || kind || ': ' || n || ', ' || s || ', in ' || array_to_string(files[1:3], ', ') || CASE WHEN len(files) > 3 THEN ' and ' || (len(files) - 3) || ' more' ELSE '' END, chr(10) ORDER BY n DESC, kind DESC) AS text FROM k GROUP BY 1)
SELECT pr_id, 'Score ' || score || ' of 100; ' || total || ' findings, ' || high || ' high, ' || medium || ' medium.' || chr(10) || chr(10) || text || chr(10) || chr(10) || {_q(report.SUMMARY_TASK)} AS prompt
FROM labelled JOIN c USING (pr_id) JOIN t USING (pr_id)""",
    "job_outputs": f"""{_N}, {_VALID},
first_valid AS (SELECT pr_id, file, coalesce(line, 0) AS l, kind, min_by(false_positive, seq) AS fp FROM valid GROUP BY ALL),
real AS (SELECT f.* FROM findings f WHERE NOT EXISTS (SELECT 1 FROM first_valid v WHERE v.fp AND v.pr_id = f.pr_id AND v.file = f.file AND v.l = coalesce(f.line, 0) AND v.kind = f.kind)), {_score_sql('real', 'pr_id')},
c AS (SELECT pr_id, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM real GROUP BY 1),
v AS (SELECT pr_id, count(*) FILTER (false_positive) AS filtered, list('- **[' || upper(severity) || ']** ' || {_PLACE} || ' ' || kind ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, seq) FILTER (NOT false_positive) AS l FROM valid GROUP BY 1)
SELECT pr_id, score, total AS findings_count, high AS high_count, high > 0 AS failed, concat_ws(chr(10) || chr(10), '**Score:** ' || score || '/100 (' || label || ')',
  '| Severity | Findings |' || chr(10) || '| --- | --- |' || chr(10) || '| high | ' || high || ' |' || chr(10) || '| medium | ' || medium || ' |' || chr(10) || '| low | ' || low || ' |',
  CASE WHEN filtered > 0 THEN filtered || ' left out as likely false positives' END, array_to_string(l[1:5], chr(10))) AS summary
FROM labelled JOIN c USING (pr_id) JOIN v USING (pr_id)""",
    "issues_by_kind": """
WITH i AS (
  SELECT event_id % 50 AS batch, event_id * 10 AS ord, CASE WHEN event_id % 2 = 0 THEN 'RESILIENCE_GAP' ELSE 'SCALING_RISK' END AS kind, 't' || event_id AS title FROM events WHERE event_id % 10 < 2
  UNION ALL SELECT event_id % 50, event_id * 10 + 1, 'SCALING_RISK', 'Unknown issue' FROM events WHERE event_id % 10 = 0),
g AS (SELECT batch, kind, count(*) AS count, min(ord) AS o, string_agg(title, ',' ORDER BY ord) AS titles FROM i GROUP BY 1, 2)
SELECT batch, kind, count, row_number() OVER (PARTITION BY batch ORDER BY o, kind) AS rank, titles FROM g""",
    "model_tiers": f"{_N} SELECT pr_id, CASE WHEN kind IN {_sql_list(COMPLEX_RULES)} THEN 'reasoning' ELSE 'fast' END AS tier, count(*) AS n FROM findings GROUP BY 1, 2 UNION ALL SELECT DISTINCT pr_id, 'balanced', 1 FROM findings",
    "transient_errors": """
WITH e AS (SELECT event_id, event_id % 8 IN (0, 1, 3, 5, 6) AS transient, event_id % 5 AS attempt FROM events)
SELECT event_id, transient, CASE WHEN transient AND attempt < 3 THEN (CASE attempt WHEN 0 THEN 1000 WHEN 1 THEN 2000 ELSE 4000 END + event_id % 10 * 10)::BIGINT END AS delay_ms FROM e""",
    "webhook_signatures": f"SELECT event_id, event_id % 3 = 0 AS valid, CASE event_id % 3 WHEN 0 THEN {_hmac('props', SECRET)} WHEN 1 THEN {_hmac('props', 'another')} END AS signature FROM events WHERE props IS NOT NULL",
    "request_timeouts": "SELECT event_type, count(*) FILTER (value * 1000 > CASE WHEN event_type = 'click' THEN 120000 ELSE 30000 END) AS timed_out FROM events GROUP BY 1",
    "log_lines": """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS t, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level FROM events)
SELECT event_id, '{"level":"' || level || '","timestamp":"' || t || '","message":"' || event_type || '","event_id":' || event_id || ',"user_id":' || user_id || '}' AS line FROM e
UNION ALL SELECT -event_id - 1, '[' || t || '] ' || upper(level) || ' ' || event_type || ' {"event_id":' || event_id || ',"user_id":' || user_id || '}' FROM e""",
    "positions_in_ranges": """
WITH r AS (SELECT p_partkey, p_partkey % 9 + 1 AS a, p_partkey % 5 AS ac, p_partkey % 9 + 1 + p_partkey % 3 AS b, p_partkey % 7 + 1 AS bc, p_partkey % 11 + 1 AS l, p_partkey % 8 AS c FROM part)
SELECT p_partkey, l * 100 + c BETWEEN a * 100 + ac AND b * 100 + bc AS inside, b > a AND l > a AND l < b AS whole_line FROM r""",
    "tree_of_snapshots": f"{_FILES} SELECT repo, count(*) AS files, sum(length(content))::BIGINT AS chars FROM files WHERE regexp_matches(filename, '\\.(ts|tsx|js|jsx|py|go|rb|java|cs)$') AND NOT contains(filename, '.test.') AND NOT contains(filename, '/tests/') GROUP BY 1",
}

# what each written source holds, and its part
_LANGUAGES = {"ts": "typescript", "js": "javascript", "py": "python", "go": "go", "rb": "ruby"}
_found = ", ".join(f"({k}, {f.split()[0]}, '{f.split()[1]}')" for k, (_, _, found) in enumerate(snippets.SNIPPETS) for f in found)
_spans = ", ".join(f"({k}, '{r.split()[0]}', {r.split()[1].replace('-', ', ')})" for k, (_, _, rs) in enumerate(snippets.RANGES) for r in rs)
_texts = ", ".join(f"({k}, {_q(name)}, {_q(text)})" for k, (name, _, text) in enumerate(snippets.OUTLINES))
_named = ", ".join(f"({k}, '{_LANGUAGES[name.split('.')[1]]}')" for k, (name, *_) in enumerate(snippets.SNIPPETS) if name.split(".")[1] in _LANGUAGES)
SQL |= {
    "ast_snippets": f"SELECT p_partkey AS file_key, line, kind FROM part JOIN (VALUES {_found}) f(k, line, kind) ON p_partkey % {len(snippets.SNIPPETS)} = k",
    "ast_snippet_status": f"SELECT p_partkey AS file_key, language, true AS parse_success FROM part JOIN (VALUES {_named}) f(k, language) ON p_partkey % {len(snippets.SNIPPETS)} = k",
    "hybrid_snippets": f"SELECT p_partkey AS file_key, line, kind FROM part JOIN (VALUES {_found}) f(k, line, kind) ON p_partkey % {len(snippets.SNIPPETS)} = k WHERE line % 2 = 1",
    "ignored_range_snippets": f"SELECT p_partkey AS file_key, range_type, start_line, end_line FROM part JOIN (VALUES {_spans}) f(k, range_type, start_line, end_line) ON p_partkey % {len(snippets.RANGES)} = k",
    "outline_snippets": f"SELECT p_partkey AS file_key, filename, outline FROM part JOIN (VALUES {_texts}) f(k, filename, outline) ON p_partkey % {len(snippets.OUTLINES)} = k",
}
