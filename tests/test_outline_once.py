from pyspark.sql import functions as F

from crosscut.operators import outline


def test_contents_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def content(i):
        seen.add(1)
        return f"import {{\n  a\n}} from 'm{i}';\n@deco\nclass K{i}:\n  x = 1\nexport function f(a) {{"

    files = spark.range(6).select(F.col("id").alias("file_key"), F.concat(F.lit("f"), "id").alias("filename"), content("id").alias("content"))
    rows = outline.outline(files).collect()
    assert len(rows) == 6 and all("import { ... } from 'm" in r.outline and "@deco class K" in r.outline for r in rows)
    assert seen.value == 6
