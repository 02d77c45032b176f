"""Each distinct configuration text is read once, in more tasks than its table has partitions."""

from crosscut.sources import repo_config


def test_texts_are_read_once_and_in_many_tasks(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    real = repo_config.load

    def noted(text, *more, _real=real, _log=str(log)):
        import os
        import uuid

        from pyspark import TaskContext

        name = "none" if text is None else text.split("/")[-1].split("'")[0]
        open(os.path.join(_log, f"{name}-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"), "w").close()
        return _real(text, *more)

    entries = repo_config._entries
    scope = {**entries.__globals__, "load": noted}
    monkeypatch.setattr(repo_config, "_entries", type(entries)(entries.__code__, scope, "_entries"))
    # by value, as the workers would import the module without the change
    monkeypatch.setattr(repo_config._entries, "__module__", "__main__")
    rows = [(k, f"files: {{ignore: ['src/{k % 40}']}}" if k % 41 else None, "rules: {}" if k % 2 else None) for k in range(400)]
    given = spark.createDataFrame(rows, "repo long, head string, base string").coalesce(1)
    got = repo_config.config_entries(given).where("part = 'ignore'").collect()
    assert sorted((r["repo"], r["prefix"]) for r in got) == [(k, "src/") for k in range(400) if k % 41]
    read = [f.name.split("-") for f in log.iterdir()]
    assert len(read) == 42  # forty texts, the base's and none
    assert len({task for _, task, _ in read}) > 1


def test_every_row_of_a_repository_keeps_its_entries(spark):
    given = spark.createDataFrame([(1, "rules: {A: {level: info}}", None), (1, None, "rules: {B: {level: info}}"), (None, "a: [", None), (2, None, None)], "repo long, head string, base string")
    e = repo_config.config_entries(given)
    assert sorted(r["rule"] for r in e.where("part = 'rule'").collect()) == ["A", "B"]
    assert e.where("part = 'scalar'").groupBy("repo").count().count() == 3
    assert e.where("part = 'scalar'").count() == 36
