"""The rules on small patches, and against a line-by-line evaluator on random ones."""

import random
import re

import pytest

from crosscut.functions import patterns
from crosscut.operators import file_rules, neighbourhood, patch_rules
from crosscut.plans import derived


def found(spark, files, cap=50):
    df = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(files)], "file_key long, filename string, patch string")
    return patch_rules.analyze_patches(df, cap).collect()


def kinds(spark, body, name="src/a.ts"):
    patch = "@@ -1 +1 @@\n" + "\n".join("+" + x for x in body)
    return sorted({(r["kind"], r["line"]) for r in found(spark, [(name, patch)])})


CASES = [
    (["const a = await fetch(u)"], ("UNSAFE_IO", 1), True),
    (["try {", "const a = await fetch(u)", "}"], ("UNSAFE_IO", 2), False),
    (["for (const x of xs) {", "  await fetch(x)", "}"], ("LOOPED_IO", 2), True),
    (["for (const x of xs) {", "  await fetch(x)", "}"], ("MISSING_BATCHING", 1), True),
    (["for (const x of chunks) {", "  await fetch(x)", "}"], ("MISSING_BATCHING", 1), False),
    (["orders.findMany()"], ("UNBOUNDED_QUERY", 1), True),
    (["orders.findMany()", "  .limit(3)"], ("UNBOUNDED_QUERY", 1), False),
    (["app.get('/', h)", "const n = req.body.n"], ("UNVALIDATED_INPUT", 2), True),
    (["app.get('/', h)", "const n = schema.parse(req.body)"], ("UNVALIDATED_INPUT", 2), False),
    (["} catch (e) {", "}"], ("SILENT_ERROR", 1), True),
    (["catch (e) {"], ("SILENT_ERROR", 1), True),
    (["catch (e) {", "}"], ("SILENT_ERROR", 1), False),  # the block's lines keep their +, which is not blank
    (["catch (e) {", "  // nothing"], ("SILENT_ERROR", 1), False),
    (["catch (e) {", "  recover()"], ("SILENT_ERROR", 1), False),
    (["let n = 0", "n = n + 1"], ("GLOBAL_MUTATION", 1), True),
    (["const n = 0", "m = n + 1"], ("GLOBAL_MUTATION", 1), False),
    (["fetch('http://a/x')", "y()", "fetch('http://a/x')"], ("NO_CACHING", 1), True),
    (["return ({ a: 1 })", "return ({ b: 1 })"], ("MIXED_RESPONSE_SHAPES", 1), True),
    (["return ({ a: 1 })", "return ({ a: 2 })"], ("MIXED_RESPONSE_SHAPES", 1), False),
    (["while (true) {", "work()", "}"], ("BUSY_WAIT_OR_TIGHT_LOOP", 1), True),
    (["while (true) {", "await delay(5)", "}"], ("BUSY_WAIT_OR_TIGHT_LOOP", 1), False),
    (["u.findOne(k)", "u.create(k)"], ("CHECK_THEN_ACT_RACE", 1), True),
    (["re.exec(text)"], ("UNSAFE_EVAL", 1), False),
    (["exec(text)"], ("UNSAFE_EVAL", 1), True),
    (["// éTODO"], ("TEMPORARY_HACK", 1), True),
    (["// TODOS"], ("TEMPORARY_HACK", 1), False),
    (["x!.y"], ("DATA_SHAPE_ASSUMPTION", 1), True),
    (["const k = `postgres://u:p@h/d`"], ("HARDCODED_SECRET", 1), True),
    (["fs.readFileSync(p)"], ("BLOCKING_OPERATION", 1), True),
    (["this.cache = new Map()"], ("STATEFUL_SERVICE", 1), True),
    (["import sqlite3"], ("PROTOTYPE_INFRA", 1), True),
    (["const u = 'http://localhost:80/'"], ("HARDCODED_URL", 1), True),
    (["retry(() => fetch(u))"], ("RETRY_STORM_RISK", 1), True),
    (["writeFile('./a', t)"], ("SHARED_FILE_WRITE", 1), True),
    (["async function f() {", "g.then(h)", "}"], ("ASYNC_MISUSE", 2), True),
    (["app.get('/', h)", "users.map(f)"], ("UNBOUNDED_COLLECTION_PROCESSING", 2), True),
    (["x.toString()"], ("MEMORY_RISK", 1), True),
    (["console.log(1)"], ("CONSOLE_DEBUG", 1), True),
]


def test_each_rule(spark):
    files = [(f"src/f{i}.ts", "@@ -1 +1 @@\n" + "\n".join("+" + x for x in body)) for i, (body, _, _) in enumerate(CASES)]
    got = {}
    for r in found(spark, files):
        got.setdefault(r["file_key"], set()).add((r["kind"], r["line"]))
    wrong = [(b, w, e) for i, (b, w, e) in enumerate(CASES) if (w in got.get(i, set())) != e]
    assert not wrong


def test_test_files_keep_secrets_but_not_debugging(spark):
    got = kinds(spark, ["console.log(1)", "const password = 'abcdefghijklmnopqrstuvwx'"], "a.test.ts")
    assert got == [("HARDCODED_SECRET", 2)]


def test_cap_is_tested_before_each_line(spark):
    body = "@@ -1 +1 @@\n" + "\n".join("+console.log(fetch(a))" for _ in range(10))
    assert len(found(spark, [("a.ts", body)], None)) == 21  # two a line, and the repeated call
    assert len(found(spark, [("a.ts", body)], 5)) == 6  # the line that reaches the cap keeps all of its own


def test_whole_files(spark):
    df = spark.createDataFrame([(1, "a.ts", "let x = []\nthis.cache = {}\n" + "eval(a)\n" * 60), (2, "b.spec.ts", "token = 'abcdefghijklmnopqrstuvwxyz'")], "file_key long, filename string, content string")
    got = file_rules.analyze_files(df).collect()
    assert len([r for r in got if r["file_key"] == 1]) == 50
    assert {(r["kind"], r["line"], r["severity"]) for r in got if r["line"] < 3} == {("GLOBAL_MUTATION", 1, "medium"), ("STATEFUL_SERVICE", 2, "high")}
    assert not [r for r in got if r["file_key"] == 2]
    assert file_rules.analyze_files(df, ["NO_SUCH_RULE"]).count() == 0


SILENT = [
    (["} catch (e) {", "  handle(e)"], True),
    (["catch (e)", "next()"], True),
    (["try { f() } catch (e) {", "  // nothing", "}"], True),
    ([" } catch (e) {{", "   console.log(e);", " }", " }"], False),
    ([" catch (e) {", "", " }"], True),
    ([" catch (e) {", "   // only a note", " }"], True),
    ([" catch (e) {", "   console.error(e);", " }"], True),
    ([" catch (e) {", "   console.error(e); throw e;", " }"], False),
    ([" catch (e) {", "   recover();", " }"], False),
]


def silent(lines):
    """As the rule's text says, by a loop."""
    depth, seen, block = 0, False, []
    for i, line in enumerate(lines[:10]):
        seen = seen or "{" in line
        depth += line.count("{") - line.count("}")
        if seen and i:
            block.append(line)
        if seen and depth == 0:
            break
    text = re.sub("[{}]", "", "\n".join(block)).strip()
    if not re.sub("//[^\n]*", "", text).strip():
        return True
    return bool(re.fullmatch(r"(?:\s*console\.(?:log|error|warn)\([^)]*\);\s*)+", text)) and not re.search("throw|return|reject", text)


def test_silent_catch(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(SILENT)], "i int, l array<string>")
    got = {r["i"]: r["s"] for r in df.select("i", neighbourhood.silent_catch(F.col("l")).alias("s")).collect()}
    assert got == {i: silent(x) for i, (x, _) in enumerate(SILENT)}


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_against_a_loop(spark, seed):
    rng = random.Random(seed)
    pool = [p for p in derived.PALETTE if p is not None]
    files = {k: ["@@ -1 +1 @@"] + [rng.choice("+ -") + rng.choice(pool) for _ in range(60)] for k in range(3)}
    df = spark.createDataFrame([(k, "a.ts", i, x) for k, v in files.items() for i, x in enumerate(v)], "file_key long, filename string, idx int, raw string")
    tests = {
        "near_error_handling": lambda x: re.search(patterns.re2("error_handling"), x),
        "after_loop": lambda x: re.search(patterns.re2("loop"), x),
        "before_act": lambda x: x[:1] == "+" and re.search(patterns.re2("act"), x),
        "io_around": lambda x: re.search(patterns.re2("io"), x),
        "near_validation": lambda x: re.search(patterns.re2("validation"), x.lower()),
    }
    for r in neighbourhood.with_neighbourhood(df, list(tests)).collect():
        for name, test in tests.items():
            _, lo, hi = neighbourhood.FRAMES[name]
            around = files[r["file_key"]][max(0, r["idx"] + lo) : r["idx"] + hi + 1]
            assert r[name] == any(test(x) for x in around), (name, r["idx"])
