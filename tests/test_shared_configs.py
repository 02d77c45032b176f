"""Rules are resolved once for the repositories that share a configuration."""

import pytest

from crosscut.sources import repo_config

TEXT = "rules: {UNSAFE_IO: {level: %s}}\noverrides:\n- {patterns: ['src/*.ts'], rules: {TEMPORARY_HACK: {level: error}}}\nfiles: {prototype_zone: ['src/b*']}\n"


@pytest.mark.parametrize("most", [100_000, 0])
def test_shared_as_each_its_own(spark, monkeypatch, most):
    monkeypatch.setattr(repo_config, "BROADCAST_ROWS", most)
    texts = [TEXT % "off", TEXT % "info", None, "a: ["]
    given = spark.createDataFrame([(k, texts[k % 4], None) for k in range(40)] + [(1, None, "rules: {UNSAFE_IO: {enabled: false}}")], "repo long, head string, base string")
    f = spark.createDataFrame([(k, p, rule) for k in range(44) for p in ("src/a.ts", "src/b.ts", "c.ts") for rule in ("UNSAFE_IO", "TEMPORARY_HACK", "MADE_UP")], "repo long, filename string, kind string")
    repos, shared = repo_config.shared_entries(given)
    assert repos.count() == 40 and shared.select("repo").distinct().count() == 5
    rows = lambda x: sorted(map(str, x.select("repo", "filename", "kind", "level", "is_prototype_zone").collect()))
    assert rows(repo_config.apply_repo_rules(f, shared, repos=repos)) == rows(repo_config.apply_repo_rules(f, repo_config.config_entries(given)))
