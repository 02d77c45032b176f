from pyspark.sql import functions as F

from crosscut.operators import lines


def patch(spark, text, name="src/a.ts"):
    return lines.patch_lines(spark.createDataFrame([(1, name, text)], "file_key long, filename string, patch string"))


def test_numbers_follow_hunks_and_skip_file_headers(spark):
    text = "\n".join(["--- a/x", "+++ b/x", "@@ -1,2 +10,3 @@ ctx", " keep", "-gone", "+new", "+++ odd", "\\ No newline", "@@ -9 +40 @@", "+last", ""])
    got = {r["idx"]: (r["op"], r["new_line"]) for r in lines.with_new_lines(patch(spark, text)).collect()}
    assert got[3] == (" ", 10)
    assert got[4][0] == "-"
    assert got[5] == ("+", 11)
    assert got[6][0] == "#"
    assert got[7] == (" ", 12)
    assert got[9] == ("+", 40)
    assert got[10] == (" ", 41)


def test_lines_before_any_hunk_count_from_zero(spark):
    got = [r["new_line"] for r in lines.with_new_lines(patch(spark, "+a\n+b")).orderBy("idx").collect()]
    assert got == [0, 1]


def test_changed_lines_are_distinct_added_ones(spark):
    got = lines.changed_lines(patch(spark, "diff --git a b\n@@ -1 +5 @@\n+a\n b\n+c\n@@ -1 +5 @@\n+d"))
    assert sorted(r["line"] for r in got.collect()) == [5, 7]


def test_added_text_keeps_context_and_numbers_anew(spark):
    got = lines.added_text(patch(spark, "@@ -1 +90 @@\n+a\n-b\n c\n+++ h")).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in got] == [(1, "a"), (2, " c"), (3, "+++ h")]


def test_blank_and_null_patches_give_no_lines(spark):
    df = spark.createDataFrame([(1, "a.ts", None), (2, "b.ts", " \n "), (3, "c.ts", "")], "file_key long, filename string, patch string")
    assert lines.patch_lines(df).count() == 0


def test_content_lines_keep_a_trailing_empty_line(spark):
    df = spark.createDataFrame([(1, "a.ts", "x\n")], "file_key long, filename string, content string")
    assert [(r["line_no"], r["text"]) for r in lines.content_lines(df).orderBy("line_no").collect()] == [(1, "x"), (2, "")]


def test_hunk_header_anywhere_in_a_line(spark):
    df = spark.createDataFrame([("x @@ -1,2 +33,4 @@ y",), ("@@ -a +b @@",), (None,)], "raw string")
    assert [r[0] for r in df.select(lines.hunk_start(F.col("raw"))).collect()] == [33, None, None]
