"""A summary reads its findings once, and gives what scores and counts give apart."""

from pyspark.sql import functions as F

from crosscut.operators import score
from crosscut.plans import analyses


def test_one_pass(spark, tmp_path):
    rows = [(k % 7, k, "a.ts" if k % 2 else "b.ts", None if k % 5 == 0 else k % 3, ["UNSAFE_IO", "TEMPORARY_HACK"][k % 2], ["high", "medium", "low", None][k % 4], "warning", k % 11 == 0) for k in range(60)]
    spark.createDataFrame(rows, "pr_id long, seq int, file string, line int, kind string, severity string, level string, false_positive boolean").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    x = analyses.summarize(v, v)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in p for p in plan.split("\n")) == 2  # findings, and those taken for false positives
    real = v.where(~F.expr("exists(array(0), z -> false)"))
    both = score.scores(real).join(score.severity_counts(real), "pr_id")
    one = score.scores(real, counts=True)
    assert one.schema == both.schema and sorted(map(tuple, one.collect())) == sorted(map(tuple, both.collect()))
