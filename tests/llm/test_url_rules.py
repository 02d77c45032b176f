"""op1's rules against the contract's list."""

from crosscut.llm.queries import op1_url_filter

CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_each_rule_gives_the_contracts_verdict(spark, tmp_path):
    urls = [f"https://a.{rule}x?q" for rule in CONTRACT] + ["https://example.net/de/7", "https://a.net/en/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = [(r["rule"], r["verdict"]) for r in op1_url_filter(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert rows == [*CONTRACT.items(), ("net/de/", "allow"), (None, "allow"), (None, "allow")]
