"""Job outputs are made where findings are dealt by change set: nothing is dealt again, written or joined after that."""

from pyspark.sql import functions as F

from crosscut.operators import report, validation
from crosscut.plans import analyses, finding_queries, service_queries

SF = "/root/testdata/sf0.001"


def test_dealt_once(spark):
    plan = service_queries.job_outputs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert plan.count("Exchange hashpartitioning") <= 3  # two of the join that makes findings, and the one by change set
    assert plan.count("Join") == 1 and "crosscut-stage" not in plan


def test_same_as_in_steps(spark):
    v = spark.createDataFrame(
        [(k % 5, k, None if k % 13 == 0 else f"f{k % 2}.ts", None if k % 4 == 0 else k % 3, ["UNSAFE_IO", "TEMPORARY_HACK"][k % 2], ["high", "medium", "low"][k % 3], "warning", k % 7 == 0 or k % 5 == 4) for k in range(80)],
        "pr_id long, seq int, file string, line int, kind string, severity string, level string, false_positive boolean",
    )
    s = analyses.summarize(v, v)
    want = report.job_outputs(s.select("pr_id", "score", "label"), s.select("pr_id", "total", "high", "medium", "low"), v)
    assert sorted(map(tuple, analyses.job_outputs(v).collect())) == sorted(map(tuple, want.collect()))


def test_answers_of_findings_themselves(spark):
    f = finding_queries.n_(spark, SF)
    a = f.where("confidence is not null and seq % 3 <> 0").withColumn("reasoning", F.lit("checked"))
    apart = validation.validate(f.drop("confidence"), a)
    assert sorted(map(str, finding_queries.valid_once(spark, SF).select(*apart.columns).collect())) == sorted(map(str, apart.collect()))
    twice = a.unionByName(a.withColumn("line", F.lit(0).cast("long")).where("line is null")).unionByName(a.where("line is null").withColumn("line", F.lit(0).cast("long")))
    assert validation.validate(f.drop("confidence"), twice).count() == f.count()  # answers with line 0 and with none are for one line
