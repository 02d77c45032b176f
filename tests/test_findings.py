from crosscut.functions import text as X
from crosscut.operators import group, merge, outline, review_answers, score, suppress, validation
from crosscut.plans import analyses, finding_queries
from crosscut.sources import scans
from crosscut.sources.config import Config, apply_rules, load

COLS = "pr_id long, seq int, file string, line int, kind string, severity string, level string, message string"


def findings(spark, rows):
    return spark.createDataFrame([(1, i, *r, None) for i, r in enumerate(rows)], COLS)


def test_score_weighs_kind_severity_and_level(spark):
    f = findings(spark, [("a", 1, "UNBOUNDED_QUERY", "high", "error"), ("a", 2, "UNSAFE_IO", "medium", "warning"), ("a", 3, "CONSOLE_DEBUG", "low", "info"), ("a", 4, "UNSAFE_IO", "high", None)])
    r = score.scores(f).first()
    assert (r["score"], r["label"], r["high_risk"]) == (72, "Moderate risk", False)  # 100 - 15 - 2.5 - 0.4 - 10


def test_score_stays_within_bounds(spark):
    f = findings(spark, [("a", i, "UNBOUNDED_QUERY", "high", "error") for i in range(9)])
    assert score.scores(f).first()["score"] == 0
    assert score.scores(f, "0").first()["label"] == "Excellent"


def test_directives(spark):
    src = spark.createDataFrame([(1, "// risk-ignore-file ALL\r\nx // RISK-IGNORE-LINE UNSAFE_IO, nothing LOOPED_IO - why\n// risk-ignore-next-line ALL because\n// risk-ignore-line unsafe_io")], "file_key long, text string")
    got = [(r["line"], r["scope"], r["all_rules"], r["rules"]) for r in suppress.parse_directives(src).orderBy("line").collect()]
    assert got == [(1, "file", True, []), (2, "line", False, ["UNSAFE_IO", "LOOPED_IO"])]


def test_suppression_scopes(spark):
    d = spark.createDataFrame([(1, 5, "next-line", False, ["UNSAFE_IO"]), (1, 9, "line", True, []), (2, 1, "file", True, [])], "file_key long, line int, scope string, all_rules boolean, rules array<string>")
    f = spark.createDataFrame([(1, 6, "UNSAFE_IO"), (1, 5, "UNSAFE_IO"), (1, 6, "LOOPED_IO"), (1, 9, "LOOPED_IO"), (1, None, "UNSAFE_IO"), (2, 3, "LOOPED_IO"), (2, 3, "OTHER"), (1, 9, "OTHER")], "file_key long, line int, kind string")
    got = sorted((r["file_key"], r["line"] or 0, r["kind"]) for r in suppress.suppress(f, d).collect())
    assert got == [(1, 0, "UNSAFE_IO"), (1, 5, "UNSAFE_IO"), (1, 6, "LOOPED_IO"), (1, 9, "OTHER")]


def test_ranges_hide_findings_but_not_markers_in_comments(spark):
    f = spark.createDataFrame([(1, 3, "UNSAFE_IO"), (1, 3, "TEMPORARY_HACK"), (1, 8, "TEMPORARY_HACK"), (1, None, "UNSAFE_IO"), (2, 3, "UNSAFE_IO")], "file_key long, line int, kind string")
    r = spark.createDataFrame([(1, 2, 4, "comment"), (1, 8, 8, "string")], "file_key long, start_line int, end_line int, range_type string")
    got = sorted((x["file_key"], x["line"] or 0, x["kind"]) for x in merge.outside_ranges(f, r).collect())
    assert got == [(1, 0, "UNSAFE_IO"), (1, 3, "TEMPORARY_HACK"), (2, 3, "UNSAFE_IO")]


def test_merge_prefers_structural_findings(spark):
    cols = "file_key long, seq int, line int, kind string"
    s = spark.createDataFrame([(1, 1, 4, "UNSAFE_IO"), (1, 2, 9, "MEMORY_RISK")], cols)
    t = spark.createDataFrame([(1, 1, 5, "LOOPED_IO"), (1, 2, 9, "MEMORY_RISK"), (1, 3, 7, "CONSOLE_DEBUG"), (2, 4, 5, "LOOPED_IO")], cols)
    got = sorted((r["file_key"], r["line"], r["kind"], r["origin"]) for r in merge.merge_structural(s, t).collect())
    assert got == [(1, 4, "UNSAFE_IO", "structural"), (1, 7, "CONSOLE_DEBUG", "textual"), (1, 9, "MEMORY_RISK", "textual"), (2, 5, "LOOPED_IO", "textual")]


def test_validation_defaults_and_cap(spark):
    f = findings(spark, [("a", 1, "LOOPED_IO", "high", "error"), ("a", 2, "UNSAFE_EVAL", "high", "error"), ("a", None, "UNSAFE_IO", "low", "error"), ("a", 4, "LOOPED_IO", "high", "error")])
    a = spark.createDataFrame([(1, "a", 0, "UNSAFE_IO", 1.7, "r")], "pr_id long, file string, line int, kind string, confidence double, reasoning string")
    got = [(r["confidence"], r["false_positive"]) for r in validation.validate(f, a, cap=3).orderBy("seq").collect()]
    assert got == [(0.5, True), (0.7, False), (1.0, False), (0.7, False)]


def test_grouping_order_and_severity_of_false_first_rows(spark):
    f = findings(spark, [("a", 1, "LOOPED_IO", "low", None), ("b", 2, "UNSAFE_IO", "high", None), ("c", 3, "LOOPED_IO", "medium", None)])
    g = group.by_kind(f).orderBy("rank").collect()
    assert [(r["kind"], r["severity"], r["count"]) for r in g] == [("UNSAFE_IO", "high", 1), ("LOOPED_IO", "medium", 2)]
    v = spark.createDataFrame([(1, 0, "a", 1, "K", "high", 0.1, True, None), (1, 1, "a", 2, "K", "low", 0.9, False, None), (1, 2, "a", 3, "M", "low", 0.1, True, None)], "pr_id long, seq int, file string, line int, kind string, severity string, confidence double, false_positive boolean, message string")
    got = group.validated_by_kind(v).collect()
    assert [(r["kind"], r["severity"], r["count"], r["filtered_count"]) for r in got] == [("K", "high", 1, 1)]


def test_architecture_order(spark):
    f = findings(spark, [("a", 1, "LOOPED_IO", "high", None), ("b", 2, "MEMORY_RISK", "medium", None), ("c", 3, "LOOPED_IO", "low", None), ("d", 4, "CONSOLE_DEBUG", "low", None)])
    r = group.architecture(f).collect()
    assert [(x["category"], x["count"], [t["file"] for t in x["top"]]) for x in r] == [("scaling", 3, ["b", "a"])]
    assert [t["file"] for t in group.architecture(f, strict=False).first()["top"]] == ["a", "b"]


def test_config_overrides_in_order(spark):
    c = load("rules:\n  UNSAFE_IO: {level: info}\noverrides:\n  - patterns: ['src/**']\n    rules: {UNSAFE_IO: {level: error}}\n  - patterns: ['src/a/*.ts']\n    rules: {UNSAFE_IO: {enabled: false}}\n")
    f = spark.createDataFrame([("x.ts", "UNSAFE_IO"), ("src/b.ts", "UNSAFE_IO"), ("src/a/c.ts", "UNSAFE_IO"), ("x.ts", "CUSTOM")], "filename string, kind string")
    got = sorted((r["filename"], r["kind"], r["level"]) for r in apply_rules(f, c).collect())
    assert got == [("src/b.ts", "UNSAFE_IO", "error"), ("x.ts", "CUSTOM", None), ("x.ts", "UNSAFE_IO", "info")]


def test_broken_config_gives_defaults():
    assert load("a: [") == Config() == load(None) == load("7")
    assert load("scoring: {limit: 40}", {"limit": "high_risk_score"}).high_risk_below == 40
    assert load("scoring: {high_risk_score: 40}\nreporting: {max_issues_per_pr: 9}").raw["reporting"]["max_issues_per_pr"] == 9


def test_globs(spark):
    from pyspark.sql import functions as F

    cases = [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**", "src/a/.b", True), ("{a,b}/?.js", "b/x.js", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.ts", "aXts", False), ("dist/**", "dist\\x", True)]
    for glob, path, want in cases:
        df = spark.createDataFrame([(path,)], "p string")
        assert df.select(X.matches_globs(F.col("p"), [glob])).first()[0] == want, (glob, path)


def test_review_answers(spark):
    rows = [(1, 'x {"issues": [{"kind": "ODD", "severity": "bad", "explanation": "e", "line": "x"}]} y'), (2, '{"issues": [{"title": "t", "severity": "high"}, {"ti'), (3, "{}"), (4, None), (5, '{"issues": [')]
    df = spark.createDataFrame([(i, "d.ts", a) for i, a in rows], "id int, file string, answer string")
    got = [(r["id"], r["kind"], r["title"], r["issue_file"], r["summary"], r["severity"], r["line"]) for r in review_answers.issues(df).collect()]
    assert sorted(got) == [(1, "SCALING_RISK", "Unknown issue", "d.ts", "e", "medium", None), (2, "SCALING_RISK", "t", "d.ts", "No summary provided", "high", None)]


def test_outline(spark):
    src = "import {\n  a,\n} from 'm';\nimport b from 'n'\n// c\n@dec\nexport class K {\n  x() {}\n}\ndef f(a)\n"
    df = spark.createDataFrame([(1, "k.ts", src)], "file_key long, filename string, content string")
    text = outline.outline(df).first()["outline"]
    assert text.split("\n") == ["## File Structure: k.ts", "", "*Total lines: 11 | Imports: 2 | Definitions: 2*", "", "### Imports", "- `import { ... } from 'm'`", "- `import b from 'n'`", "", "### Definitions", "- Class: `@dec export class K {`", "- Function: `def f(a)`", ""]
    assert outline.compact(df).first()["summary"] == "k.ts: 11 lines, 2 imports, 1 class, 1 fn"


def test_baseline_limits(spark):
    files = spark.createDataFrame([("r", i, i, n, c) for i, (n, c) in enumerate([("a.md", "x"), ("b.ts", "eval(a)"), ("c.ts", "// risk-ignore-file ALL\neval(a)"), ("d.ts", "eval(a)"), ("e.md", "")])], "repo string, file_key long, file_ord int, filename string, content string")
    found, stats = analyses.analyze_repository(files, max_files=2)
    assert [(r["file_key"], r["line"], r["kind"]) for r in found.collect()] == [(1, 1, "UNSAFE_EVAL")]
    assert stats.first().asDict() == {"repo": "r", "files_analyzed": 2, "files_skipped": 1, "truncated": True}


def test_content_decoding(spark):
    import base64

    rows = [("file", 5, base64.b64encode(b"a\xc3\xa9b").decode()), ("dir", 5, "YQ=="), ("file", 99999, "YQ=="), ("file", 0, "")]
    got = [r["content"] for r in scans.decoded_content(spark.createDataFrame(rows, "kind string, size long, encoded string")).collect()]
    assert got == ["aéb", None, None, None]


def test_every_event_has_an_answer(spark):
    d = "/root/testdata/sf0.001"
    got = finding_queries._answers(spark, d)
    assert got.count() == spark.read.parquet(f"{d}/events.parquet").count()
    assert got.where("answer is null").count() == 0 and got.select("answer").distinct().count() >= 10


def test_running_sums_over_one_huge_group(spark):
    import random

    from crosscut.sources.staging import running

    rng = random.Random(2)
    rows = [("big", k, rng.choice([None, 1, 5, 7])) for k in range(3000)] + [(None, k, 2) for k in range(5)] + [(f"r{k}", 0, k) for k in range(40)]
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, "repo string, ord int, v long").repartition(7), ("repo",), ("ord",), "v").collect()
    n, s, want = {}, {}, set()
    for repo, k, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.add((repo, k, v, n.get(repo, 0), s.get(repo, 0)))
        n[repo], s[repo] = n.get(repo, 0) + 1, s.get(repo, 0) + (v or 0)
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
