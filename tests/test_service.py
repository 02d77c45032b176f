"""What surrounds the analysis, and configuration that is not as it should be."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crosscut.functions import patterns
from crosscut.operators import group, service
from crosscut.operators.nodes import syntax_nodes
from crosscut.plans import service_queries
from crosscut.sources import config

from .test_entry import DIR, check


@pytest.mark.parametrize("name", list(service_queries.QUERIES))
def test_query_equals_sql(spark, name):
    check(spark, name)


@pytest.mark.parametrize("secret", ["s", "k" * 64, "long" * 40, "é"])
def test_signature_is_the_hmac(spark, secret):
    texts = ["", "x", '{"a": 1}', "é" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "payload string").select("payload", service.signature(F.col("payload"), secret).alias("s")).collect()
    assert all(r["s"] == "sha256=" + hmac.new(secret.encode(), r["payload"].encode(), hashlib.sha256).hexdigest() for r in rows)
    df = spark.createDataFrame([("x", None), (None, "sha256=0"), ("x", "sha256=0")], "payload string, signature string")
    assert not any(r["valid"] for r in service.verified(df, secret).collect())


def test_retries_end(spark):
    df = spark.createDataFrame([(k, "timeout") for k in range(5)] + [(0, "bad request"), (0, None)], "attempt int, error string")
    got = [r["d"] for r in df.select(service.retry_delay(F.col("attempt"), F.col("error"), F.lit(0.5)).alias("d")).collect()]
    assert got == [1050.0, 2050.0, 4050.0, None, None, None, None]


def test_issues_keep_their_order(spark):
    df = spark.createDataFrame([(1, 2, "B", "x"), (1, 1, "A", "y"), (1, 3, "A", "z"), (2, 1, "C", "w")], "pr_id int, ord int, kind string, title string")
    got = [(r["pr_id"], r["kind"], r["count"], r["rank"], [i["title"] for i in r["issues"]]) for r in group.issues_by_kind(df).orderBy("pr_id", "rank").collect()]
    assert got == [(1, "A", 2, 1, ["y", "z"]), (1, "B", 1, 2, ["x"]), (2, "C", 1, 1, ["w"])]


@pytest.mark.parametrize("text", ["rules: [x]", "rules: 3", "rules: {UNSAFE_IO: [1]}", "overrides: {a: b}", "overrides: [1, {patterns: x, rules: [y]}]", "files: {ignore: 3}", "scoring: {high_risk_score: high}", "files: x", "[1]", "3"])
def test_configuration_of_wrong_types_falls_back(spark, text):
    c = config.load(text)
    assert c.high_risk_below == 60 and c.level("UNSAFE_IO") == "error" and c.raw["files"]["ignore"] == []
    df = spark.createDataFrame([("UNSAFE_IO", "a.ts", "m")], "kind string, filename string, message string")
    assert config.apply_rules(df, c).first()["level"] == "error"


def test_broken_python_is_read_around(spark):
    source = "if x:\n    a(\n\ndef f(:\n    requests.get(1)\n\nclass K\n    b = 2\n"
    rows = syntax_nodes(spark.createDataFrame([(1, "a.py", source)], "file_key long, filename string, content string")).collect()
    assert ("call", "requests.get", 5) in {(r["kind"], r["name"], r["line"]) for r in rows}


def test_boundaries_are_translated():
    assert patterns.java_member(("rx", r"\bword\b")) == "(?<![A-Za-z0-9_])word(?![A-Za-z0-9_])"
    assert patterns.java_member(("irx", r"\b(?:a|b)\b")) == "(?i:(?<![A-Za-z0-9_])(?:a|b)(?![A-Za-z0-9_]))"
    assert all(r"\b" not in patterns.java(g) for g in patterns.GROUPS)


def test_every_query_of_the_engine_has_sql():
    without = {"ast_findings", "hybrid_findings", "pull_requests_end_to_end"}
    mine = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert mine - set(entry.oracle_sql()) == without
