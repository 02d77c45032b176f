import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosscut.llm.decontaminate import find_spans, remove_spans
from crosscut.llm.html_extract import extract
from crosscut.llm.line_dedup import dedup_lines
from crosscut.llm.quality import Model, Rule, score
from crosscut.llm.url_filter import url_filter

#: Names that operators use for columns of their own, inside or in their results.
NAMES = "_key _path _host _html host slots dropped spared _n _maybe _text _stats _id _y _d _gone _again _s _z score predicted n_words n_hit spans items n_lines n_removed size target taken copies source_size rule verdict path d p line key a.b".split()


def clashing(df, but=()):
    """df with columns of all those names, each with its name and the row's id."""
    mine = [n for n in NAMES if n not in but]
    return df.select("*", *[F.concat(F.lit(n + " "), F.coalesce(df.columns[0], F.lit(0)).cast("string")).alias(n) for n in mine]), mine


def unharmed(rows, mine, replaced, id_col):
    assert rows
    for r in rows:
        r = r.asDict()
        assert all(r[n] == f"{n} {r[id_col]}" for n in mine if n not in replaced)


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", {"k": 1}), (2, None, None)], "page_id long, url string, m map<string,int>")
    df, mine = clashing(pages)
    rows = url_filter(df, spark.createDataFrame([("com", "/en/", "block")], "host string, path string, action string")).orderBy("page_id").collect()
    assert [(r["host"], r["rule"], r["verdict"], r["m"]) for r in rows] == [("a.com", "com/en/", "block", {"k": 1}), ("", None, "allow", None)]
    unharmed(rows, mine, {"host", "path", "rule", "verdict"}, "page_id")


@pytest.mark.parametrize("block", [5, 100_000])
def test_find_spans(spark, block):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b c d e f g h i j"), ("y", "q r s t u v w x y z")], "item_id string, text string")
    df, mine = clashing(docs, ("_text",))
    df = df.withColumn("_text", F.lit("a b c d e f g h i j"))
    rows = find_spans(df, items, keep=[c for c in df.columns if c != "text"], max_block_words=block).orderBy("doc_id").collect()
    assert [r["n_hit"] for r in rows] == [10, 0] and {r["_text"] for r in rows} == {"a b c d e f g h i j"}
    unharmed(rows, mine, {"n_words", "n_hit", "spans", "items"}, "doc_id")
    rows = remove_spans(df, items, max_coverage=0.9).orderBy("doc_id").collect()
    assert [r["text"].strip() for r in rows] == ["k l", "zz"]
    unharmed(rows, mine, set(), "doc_id")


def test_extract(spark):
    df, mine = clashing(spark.createDataFrame([(k, f"http://h/{k}", f"<article><p>text {k}</p></article>") for k in range(3)], "page_id long, url string, html string"))
    rows = extract(df).collect()
    assert {r["text"] for r in rows} == {"text 0", "text 1", "text 2"}
    unharmed(rows, mine, set(), "page_id")


def test_score(spark):
    df, mine = clashing(spark.createDataFrame([(1, "word " * 9), (2, "")], "doc_id long, text string"), ("_text",))
    df = df.withColumn("_text", F.lit("another text"))
    model = Model(0.3, (Rule(((0, True, 1.0),), 1.0),))
    got = score(df, model, [c for c in df.columns if c != "text"]).orderBy("doc_id").collect()
    want = score(df.select("doc_id", "text"), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["score"], r["predicted"]) for r in got] == [tuple(r) for r in want] and got[0]["score"] != got[1]["score"]
    unharmed(got, mine, {"score", "predicted"}, "doc_id")


def test_dedup_lines(spark):
    df, mine = clashing(spark.createDataFrame([(1, "a line of its own words", 23), (2, "a line of its own words\nb", 25)], "doc_id long, text string, n_chars int"))
    rows = dedup_lines(df).orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"], r["n_removed"]) for r in rows] == [("a line of its own words", 23, 0), ("b", 1, 1)]
    unharmed(rows, mine, {"n_lines", "n_removed"}, "doc_id")


def test_pipeline_stages(spark, tmp_path):
    good = "The people of this town have known for many years that the river is rising. "
    docs = [(k, f"{good} Number {k} {' '.join(f'w{k}x{j}' for j in range(30))}", "en", f"s{k % 3}", 50) for k in range(40)] + [(7, "a row of a repeated id", "en", "s1", 22)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").createOrReplaceTempView("mine")
    df, mine = clashing(spark.table("mine"))
    spark.createDataFrame([(k, int(k % 2)) for k in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "nothing of this occurs in any of them at all")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = {"size", "source_size", "target", "copies", "taken"}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        rows = out.collect()
        if k == 4:
            assert sorted(out.columns) == sorted({*df.columns, *own})
        else:
            assert out.columns == df.columns
        unharmed(rows, mine, own if k == 4 else set(), "doc_id") if rows or k else None
