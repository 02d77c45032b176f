"""Configurations as tables against one configuration at a time."""

import random

from crosscut.functions.rules import RULE_IDS
from crosscut.sources import config, repo_config

GLOBS = ["src/**", "src/*.ts", "**/b.ts", "*.ts", "src/{a,lib}/*.ts", "src/a/b.ts", "lib/[ab].ts", "", "src/a/**", "**"]
PATHS = ["a.ts", "src/a.ts", "src/a/b.ts", "src/lib/c.ts", "lib/a.ts", "b.ts", "src\\a.ts", ""]


def text(rng):
    change = lambda: rng.choice(["{level: off}", "{level: info}", "{enabled: false}", "{level: error, enabled: true}", "{}", "3"])
    rules = lambda: "{" + ", ".join(f"{r}: {change()}" for r in rng.sample(RULE_IDS[:4], rng.randrange(4))) + "}"
    globs = lambda: "[" + ", ".join(f"'{g}'" for g in rng.sample(GLOBS, rng.randrange(4))) + "]"
    out = f"rules: {rules()}\nfiles: {{ignore: {globs()}, prototype_zone: {globs()}}}\noverrides:\n"
    return out + "".join(f"- {{patterns: {globs()}, rules: {rules()}}}\n" for _ in range(rng.randrange(4)))


def test_each_repository_by_its_own_configuration(spark):
    rng = random.Random(4)
    texts = {f"r{k}": rng.choice([text(rng), text(rng), text(rng), None, "a: [", "- x"]) for k in range(30)}
    texts["base"] = text(rng)
    given = spark.createDataFrame([(r, None if r == "base" else t, t if r == "base" else "rules: {UNSAFE_IO: {level: info}}" if t is not None else None) for r, t in texts.items()], "repo string, head string, base string")
    entries = repo_config.config_entries(given).cache()
    rows = [(r, p, k) for r in texts for p in PATHS for k in [*RULE_IDS[:4], "MADE_UP"]]
    f = spark.createDataFrame(rows, "repo string, filename string, kind string")
    got = sorted(map(str, map(tuple, repo_config.apply_repo_rules(f, entries).select("repo", "filename", "kind", "level", "is_prototype_zone").collect())))
    want, ignored = [], set()
    for r, t in texts.items():
        c = config.load(t)
        mine = f.where(f.repo == r)
        want += map(str, map(tuple, config.apply_rules(mine, c).select("repo", "filename", "kind", "level", "is_prototype_zone").collect()))
        ignored |= {(r, x["filename"]) for x in mine.where(c.ignored(mine.filename)).collect()}
    assert got == sorted(want)
    assert {tuple(x) for x in repo_config.matched_paths(f.withColumnRenamed("filename", "path"), entries, "ignore").collect()} == ignored
    assert repo_config.scalars(entries).where("high_risk_below = 60").count() == len(texts)


def test_folders():
    assert [repo_config.literal_folder(g) for g in ("src/a/*.ts", "src/a.ts", "*.ts", "a/{b,c}/d", "x/y?/z", "")] == ["src/a/", "src/", "", "a/", "x/", ""]
