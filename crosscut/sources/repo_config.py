"""Configurations of many repositories as tables: one row a rule, override and glob, joined to the findings of their repositories."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_LEVELS, RULE_IDS, lookup
from ..functions.text import glob_regex
from .config import load
from .staging import staged

ENTRIES = "repo {}, part string, ord int, rule string, level string, enabled boolean, prefix string, regex string, value string"
#: Resolved rules of up to so many (config, path, kind) are sent to all tasks; a row takes about 200 bytes.
BROADCAST_ROWS = 100_000
#: Scalars that are handed out, by section.
SCALARS = {"scoring": ("high_risk_score", "weight_multiplier"), "llm": ("enabled", "max_files", "validate_findings", "confidence_threshold"), "reporting": ("create_issues", "max_issues_per_pr", "issue_severity_threshold")}


def literal_folder(glob: str) -> str:
    """The folder, with its slash, that all paths of a glob lie in: what stands before the last slash ahead of the first wildcard."""
    plain = re.split(r"[*?\[{]", glob, maxsplit=1)[0]
    return plain[: plain.rfind("/") + 1]


def _given(rule: dict) -> tuple:
    """The level and the switch that a rule's section gives, if they are of their types."""
    level, enabled = rule.get("level"), rule.get("enabled")
    return level if isinstance(level, str) else None, enabled if isinstance(enabled, bool) else None


def _entries(repo: object, text: str | None) -> Iterator[tuple]:
    raw = load(text).raw
    for name, rule in raw["rules"].items():
        yield repo, "rule", 0, str(name), *_given(rule), None, None, None
    for k, o in enumerate(raw["overrides"], 1):
        for p in o["patterns"]:
            for name, rule in o["rules"].items():
                yield repo, "override", k, str(name), *_given(rule), literal_folder(p), glob_regex(p), None
    for part in ("ignore", "prototype_zone"):
        for k, p in enumerate(p for p in raw["files"][part] if isinstance(p, str)):
            yield repo, part, k, None, None, None, literal_folder(p), glob_regex(p), None
    for section, names in SCALARS.items():
        for n in names:
            yield repo, "scalar", 0, f"{section}.{n}", None, None, None, None, json.dumps(raw[section][n])


def _told(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, digest) of configs, and the rows of ENTRIES of each distinct text, with its digest for the repository.

    Reading YAML costs about a millisecond, so each distinct text is read once, in all tasks, however few files configs come in.
    """
    spark = configs.sparkSession
    x = configs.select("repo", F.coalesce("head", "base").alias("text")).withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    columns = [c.split()[0] for c in ENTRIES.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [e for digest, text in zip(f["digest"], f["text"], strict=True) for e in _entries(digest, text)]
            yield pd.DataFrame(rows, columns=["digest", *columns[1:]]).astype({"enabled": "boolean", "ord": "int32"})

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = x.select("digest", "text").distinct().repartition(width)
    told = staged(texts.mapInPandas(parse, ENTRIES.format("string").replace("repo", "digest", 1)), "configs")
    return x.select("repo", "digest"), told


def config_entries(configs: DataFrame) -> DataFrame:
    """ENTRIES of (repo, head, base): the YAML text at a change's head, else at its base, else the defaults; texts that hold none are read as empty ones.

    Every repository has its scalars; rules, overrides and globs only if its text names some. A row is one rule of one pattern, so a
    large configuration is many rows and no cell grows with it.
    """
    x, told = _told(configs)
    return x.join(told, "digest").select("repo", *(c for c in told.columns if c != "digest"))


def shared_entries(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, config) of (repo, head, base), and config_entries with a config for the repository: repositories of equal texts share one."""
    x, told = _told(configs)
    repos = staged(x.where("repo is not null").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("digest")), ",").alias("config")), "repos")
    of = repos.select("config").distinct().select(F.col("config").alias("repo"), F.explode(F.split("config", ",")).alias("digest"))
    return repos, of.join(told, "digest").drop("digest")


def _folders(path: Column) -> Column:
    """Every folder a path lies in, with its slash, and the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))


def _matching(paths: DataFrame, globs: DataFrame, on: list[str]) -> DataFrame:
    """paths (repo, path, ...) with the globs of their repository that they match: met by folder, then verified."""
    near = paths.withColumn("prefix", F.explode(_folders(F.replace("path", F.lit("\\"), F.lit("/")))))
    whole = F.concat(F.lit(r"\A(?:"), "regex", F.lit(r")\z"))
    return near.join(globs, [*on, "prefix"]).where(F.rlike(F.replace("path", F.lit("\\"), F.lit("/")), whole))


def matched_paths(paths: DataFrame, entries: DataFrame, part: str) -> DataFrame:
    """(repo, path) of paths that a glob of a part (ignore, prototype_zone) matches."""
    return _matching(paths.select("repo", "path").distinct(), entries.where(F.col("part") == part).select("repo", "prefix", "regex"), ["repo"]).select("repo", "path").distinct()


def resolved_rules(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo, path, kind, enabled, level, is_prototype_zone) of distinct (repo, path, kind).

    Defaults, then the repository's rules, then the overrides that match the path, in order: of each field the last one that gives it holds.
    """
    c = F.col
    base = entries.where("part = 'rule'").groupBy("repo", c("rule").alias("kind")).agg(F.max("level").alias("base_level"), F.bool_and("enabled").alias("base_on"))
    last = lambda field: F.max(F.when(c(field).isNotNull(), F.struct("ord", field)))[field]
    over = _matching(keys, entries.where("part = 'override'").select("repo", c("rule").alias("kind"), "ord", "level", "enabled", "prefix", "regex"), ["repo", "kind"])
    over = over.groupBy("repo", "path", "kind").agg(last("level").alias("over_level"), last("enabled").alias("over_on"))
    x = keys.join(base, ["repo", "kind"], "left").join(over, ["repo", "path", "kind"], "left")
    zone = matched_paths(keys, entries, "prototype_zone").withColumn("zone", F.lit(True))
    x = x.join(zone, ["repo", "path"], "left")
    level = F.coalesce("over_level", "base_level", lookup(DEFAULT_LEVELS, c("kind")))
    return x.select("repo", "path", "kind", F.coalesce("over_on", "base_on", F.lit(True)).alias("enabled"), level.alias("level"), F.coalesce("zone", F.lit(False)).alias("is_prototype_zone"))


def apply_repo_rules(findings: DataFrame, entries: DataFrame, path_col: str = "filename", repos: DataFrame | None = None) -> DataFrame:
    """Findings of enabled rules, each by its own repository's configuration, with level and is_prototype_zone; kinds that are no rules pass without a level.

    Findings need repo and kind, both not null. Rules are resolved once for each (repo, path, kind), so a repository with most of the findings has no more keys than paths.
    With the repos of shared_entries, whose entries are given then, they are resolved once for each (config, path, kind), and findings are dealt again only
    if that makes more than BROADCAST_ROWS rows. Findings are read twice.
    """
    x, by = findings.drop("level", "is_prototype_zone"), "repo"
    if repos is not None:
        # a repository that has no row has no text either
        x, by = x.where("repo is not null").join(repos, "repo", "left").na.fill("", ["config"]), "config"
    told = resolved_rules(x.select(F.col(by).alias("repo"), F.col(path_col).alias("path"), "kind").distinct(), entries)
    told = told.withColumnsRenamed({"repo": by, "path": path_col})
    if repos is not None:
        told = staged(told, "rules")
        told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told.hint("merge")
    x = x.join(told, [by, path_col, "kind"])
    known = F.col("kind").isin(RULE_IDS)
    return x.where(~known | (F.col("enabled") & (F.col("level") != "off"))).drop("enabled", *([by] if repos is not None else []))


def scalars(entries: DataFrame) -> DataFrame:
    """(repo, high_risk_below, weight_multiplier) of every repository."""
    pick = lambda n, kind: F.max(F.when(F.col("rule") == n, F.col("value"))).cast(kind)
    return entries.where("part = 'scalar'").groupBy("repo").agg(pick("scoring.high_risk_score", "int").alias("high_risk_below"), pick("scoring.weight_multiplier", "double").alias("weight_multiplier"))
