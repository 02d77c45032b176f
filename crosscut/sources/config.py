"""Project configuration: YAML to a fixed shape, and its rules as rows."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import DEFAULT_LEVELS, RULE_IDS
from ..functions.text import matches_globs

# Defaults of all sections.
DEFAULTS = {
    "version": 1,
    "rules": {},
    "files": {"ignore": [], "prototype_zone": []},
    "scoring": {"high_risk_score": 60, "weight_multiplier": 1.0},
    "llm": {"enabled": True, "max_model_tokens": 4096, "temperature": 0.1, "max_files": 50, "validate_findings": True, "confidence_threshold": 0.6},
    "reporting": {"create_issues": False, "max_issues_per_pr": 3, "issue_severity_threshold": "high", "issue_labels": ["code-risk", "technical-debt"]},
    "overrides": [],
}


@dataclass(frozen=True)
class Config:
    """A loaded configuration."""

    raw: dict = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    @property
    def high_risk_below(self) -> int:
        return self.raw["scoring"]["high_risk_score"]

    @property
    def multiplier(self) -> str:
        return str(self.raw["scoring"]["weight_multiplier"])

    def ignored(self, path: Column) -> Column:
        return matches_globs(path, self.raw["files"]["ignore"])

    def prototype_zone(self, path: Column) -> Column:
        return matches_globs(path, self.raw["files"]["prototype_zone"])

    def level(self, rule: str) -> str:
        return (self.raw["rules"].get(rule) or {}).get("level") or DEFAULT_LEVELS[rule]

    def rule_columns(self, kind: Column, path: Column) -> tuple[Column, Column]:
        """(enabled, level) of a rule for a path: defaults, then the rules section, then each matching override in order."""
        levels = {r: self.level(r) for r in RULE_IDS}
        on = {r: (self.raw["rules"].get(r) or {}).get("enabled", True) is not False for r in RULE_IDS}
        level = F.try_element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), kind)
        enabled = F.try_element_at(F.create_map(*[F.lit(x) for kv in on.items() for x in kv]), kind)
        for o in self.raw["overrides"]:
            here = matches_globs(path, o.get("patterns") or [])
            for rule, change in (o.get("rules") or {}).items():
                mine = here & (kind == rule)
                if change.get("level") is not None:
                    level = F.when(mine, change["level"]).otherwise(level)
                if change.get("enabled") is not None:
                    enabled = F.when(mine, F.lit(change["enabled"])).otherwise(enabled)
        return enabled, level


def _like(given: object, default: object) -> bool:
    """Whether a given value is of its default's type."""
    if isinstance(default, bool) or isinstance(given, bool):
        return isinstance(default, bool) and isinstance(given, bool)
    return isinstance(given, (int, float)) if isinstance(default, (int, float)) else isinstance(given, type(default))


def _rule(given: dict) -> dict:
    """A rule's section; the word off, which YAML readers may take for a truth value, is a level."""
    return given | {"level": "off"} if given.get("level") is False else given


def _override(given: object) -> dict | None:
    """patterns and rules of an override, or null for one without either."""
    if not isinstance(given, dict):
        return None
    patterns, rules = given.get("patterns"), given.get("rules")
    patterns = [p for p in patterns if isinstance(p, str)] if isinstance(patterns, list) else []
    return {"patterns": patterns, "rules": {k: _rule(v) for k, v in rules.items() if isinstance(v, dict)} if isinstance(rules, dict) else {}}


def load(text: str | None, aliases: dict[str, str] | None = None) -> Config:
    """The configuration a YAML text holds; defaults for what it lacks, and for a text that is none.

    aliases maps keys of existing files to those of DEFAULTS.
    """
    import yaml

    try:
        parsed = yaml.safe_load(text) if text else None
    except yaml.YAMLError:
        parsed = None
    raw = copy.deepcopy(DEFAULTS)
    if isinstance(parsed, dict):
        for key, default in DEFAULTS.items():
            given = parsed.get(key)
            if key == "rules":  # what is no mapping of rules to mappings says nothing
                raw[key] = {k: _rule(v) for k, v in given.items() if isinstance(v, dict)} if isinstance(given, dict) else default
            elif key == "overrides":
                raw[key] = [o for o in map(_override, given if isinstance(given, list) else []) if o]
            elif key == "version":
                raw[key] = default if given is None else given
            elif isinstance(given, dict):
                given = {(aliases or {}).get(k, k): v for k, v in given.items()}
                raw[key] = {k: given[k] if _like(given.get(k), v) else v for k, v in default.items()}
    return Config(raw)


def resolve(head: str | None, base: str | None) -> Config:
    """The head's configuration, else the base's, else the default one."""
    return load(head if head is not None else base)


def load_file(path: str) -> Config:
    """From a local file; defaults if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return load(f.read())
    except OSError:
        return Config()


def apply_rules(findings: DataFrame, config: Config, path_col: str = "filename") -> DataFrame:
    """Findings of enabled rules with level and is_prototype_zone; kinds that are no rules pass without a level."""
    known = F.col("kind").isin(RULE_IDS)
    enabled, level = config.rule_columns(F.col("kind"), F.col(path_col))
    x = findings.withColumns({"_on": enabled, "level": level, "is_prototype_zone": config.prototype_zone(F.col(path_col))})
    return x.where(~known | (F.col("_on") & (F.col("level") != "off"))).drop("_on")
