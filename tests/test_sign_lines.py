"""Lines without signs of comments or strings: no pattern is looked for in them, and no step is made again to tell whether it gives rows."""

from crosscut.operators import source_lines

TEXTS = {
    "a.ts": "let a = b\nx = 'q' // c\n/* one\nplain here\ntwo */ let c = d\ne = f",
    "b.py": 'def f(a):\n    t = """x\nplain here\n"""\n    return a # b\n\nz = y',
    "c.rb": "def f a\n=begin\nplain here\n=end\nx = <<A\nplain here\nA\ny = :b\nz = w",
}


def test_what_is_ranged_is_made_once(spark):
    files = spark.createDataFrame([(k, f, t) for k, (f, t) in enumerate(TEXTS.items())], "file_key int, filename string, content string")
    x = source_lines.ignored_ranges(source_lines.source_lines(files))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert not [p for p in plan.split("\n") if "Filter" in p and ("aggregate(" in p or "regexp_extract_all" in p)]


def test_plain_lines_within_texts_keep_their_states(spark):
    files = spark.createDataFrame([(k, f, t) for k, (f, t) in enumerate(TEXTS.items())], "file_key int, filename string, content string")
    got = {(r["file_key"], r["line"]): (r["begins"], r["ends"], r["code"], len(r["spans"])) for r in source_lines.source_lines(files).collect()}
    assert got[0, 1] == (0, 0, "let a = b", 0) and got[0, 6] == (0, 0, "e = f", 0)
    assert got[0, 4] == (1, 1, " " * 10, 1) and got[1, 3][:2] == (1, 1) and got[1, 3][3] == 1
    assert got[1, 1] == (0, 0, "def f(a):", 0) and got[1, 7] == (0, 0, "z = y", 0)
    assert got[2, 3][:2] == (3, 3) and got[2, 6] == (4, 4, " " * 10, 1) and got[2, 8][3] == 1 and got[2, 9] == (0, 0, "z = w", 0)
