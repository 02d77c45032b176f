"""An outline's own tables compress so well that Spark would broadcast them whole, through the driver; none is joined."""

from pyspark.sql import functions as F

from crosscut.operators import outline


def test_nothing_is_joined_and_odd_files_stay(spark):
    text = "import {\n  a\n} from 'm'\nimport { b\nfoo;\n\n@deco\nclass K:\n  x = 1\nimport {\n  never closed"
    rows = [(1, "a.ts", text), (2, "b.ts", None), (3, "c.ts", "")]
    files = spark.createDataFrame(rows, "file_key long, filename string, content string")
    out = outline.outline(files)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.file_key: r.outline for r in out.collect()}
    assert got[1] == "## File Structure: a.ts\n\n*Total lines: 11 | Imports: 2 | Definitions: 1*\n\n### Imports\n- `import { ... } from 'm'`\n- `import { b foo;`\n\n### Definitions\n- Class: `@deco class K:`\n"
    assert got[2] == "## File Structure: b.ts\n\n**\n" and got[3] == "## File Structure: c.ts\n\n*Total lines: 1*\n"
    many = files.crossJoin(spark.range(3).select(F.col("id").alias("k"))).select((F.col("file_key") + 10 * F.col("k")).alias("file_key"), "filename", "content")
    assert sorted((r.file_key % 10, r.outline) for r in outline.outline(many).collect()) == sorted((k, v) for k, v in got.items() for _ in range(3))
