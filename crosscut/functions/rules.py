"""The rule dimension and the other fixed tables that results depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule ids with their default levels.
DEFAULT_LEVELS: dict[str, str] = {
    "UNSAFE_IO": "error",
    "SILENT_ERROR": "error",
    "ASYNC_MISUSE": "warning",
    "UNBOUNDED_QUERY": "error",
    "UNBOUNDED_COLLECTION_PROCESSING": "error",
    "MISSING_BATCHING": "error",
    "NO_CACHING": "warning",
    "MEMORY_RISK": "error",
    "LOOPED_IO": "error",
    "BLOCKING_OPERATION": "warning",
    "SHARED_FILE_WRITE": "error",
    "RETRY_STORM_RISK": "error",
    "BUSY_WAIT_OR_TIGHT_LOOP": "error",
    "CHECK_THEN_ACT_RACE": "warning",
    "GLOBAL_MUTATION": "error",
    "UNVALIDATED_INPUT": "warning",
    "DATA_SHAPE_ASSUMPTION": "warning",
    "MIXED_RESPONSE_SHAPES": "warning",
    "HARDCODED_SECRET": "error",
    "TEMPORARY_HACK": "warning",
    "CONSOLE_DEBUG": "info",
    "STATEFUL_SERVICE": "error",
    "PROTOTYPE_INFRA": "error",
    "UNSAFE_EVAL": "error",
    "HARDCODED_URL": "warning",
}
RULE_IDS = list(DEFAULT_LEVELS)

# What a finding costs. Heavy kinds cost 15, 8 or 4 points by severity, others 10, 5 or 2; levels weigh that.
HEAVY_KINDS = ["UNBOUNDED_QUERY", "UNBOUNDED_COLLECTION_PROCESSING", "MISSING_BATCHING", "NO_CACHING", "MEMORY_RISK", "LOOPED_IO", "STATEFUL_SERVICE", "PROTOTYPE_INFRA", "SHARED_FILE_WRITE", "RETRY_STORM_RISK", "BUSY_WAIT_OR_TIGHT_LOOP", "CHECK_THEN_ACT_RACE", "HARDCODED_SECRET", "UNSAFE_EVAL"]
PENALTIES = {True: {"high": 15, "medium": 8, "low": 4}, False: {"high": 10, "medium": 5, "low": 2}}
LEVEL_WEIGHT = {"error": "1.0", "warning": "0.5", "info": "0.2", "off": "0"}
LABELS = [(90, "Excellent"), (75, "Good"), (60, "Moderate risk"), (40, "Risky"), (None, "Critical risk")]
SEVERITY_ORDER = {"high": 3, "medium": 2, "low": 1}

# Report categories in order of precedence.
CATEGORIES: dict[str, list[str]] = {
    "scaling": ["UNBOUNDED_QUERY", "UNBOUNDED_COLLECTION_PROCESSING", "MISSING_BATCHING", "NO_CACHING", "MEMORY_RISK", "LOOPED_IO", "BLOCKING_OPERATION", "STATEFUL_SERVICE"],
    "concurrency": ["SHARED_FILE_WRITE", "RETRY_STORM_RISK", "BUSY_WAIT_OR_TIGHT_LOOP", "CHECK_THEN_ACT_RACE", "GLOBAL_MUTATION", "CONCURRENCY_RISK"],
    "error_handling": ["UNSAFE_IO", "SILENT_ERROR", "MISSING_ERROR_HANDLING", "ASYNC_MISUSE"],
    "data_integrity": ["UNVALIDATED_INPUT", "DATA_SHAPE_ASSUMPTION", "MIXED_RESPONSE_SHAPES", "HIDDEN_ASSUMPTIONS", "HARDCODED_SECRET"],
    "security": ["UNSAFE_EVAL", "HARDCODED_URL", "PROTOTYPE_INFRA"],
}

# Kinds whose validation default is 0.5 instead of 0.7, and kinds for which structural findings win.
COMPLEX_RULES = ["UNBOUNDED_QUERY", "SILENT_ERROR", "LOOPED_IO", "MISSING_BATCHING", "STATEFUL_SERVICE", "GLOBAL_MUTATION", "CHECK_THEN_ACT_RACE", "RETRY_STORM_RISK"]
STRUCTURAL_KINDS = ["UNSAFE_IO", "LOOPED_IO", "UNBOUNDED_QUERY", "GLOBAL_MUTATION", "SILENT_ERROR", "CHECK_THEN_ACT_RACE", "BLOCKING_OPERATION", "SHARED_FILE_WRITE", "ASYNC_MISUSE"]

# The kinds that a scan of whole files looks for, by default and for a baseline.
FILE_RULES = ["STATEFUL_SERVICE", "PROTOTYPE_INFRA", "HARDCODED_SECRET", "UNSAFE_EVAL", "GLOBAL_MUTATION"]

#: What reports call a kind of finding.
DESCRIPTIONS: dict[str, str] = {
    "UNBOUNDED_QUERY": "Rows are read without a bound",
    "LOOPED_IO": "One request for each turn of a loop",
    "MEMORY_RISK": "Whole data set held at once",
    "GLOBAL_MUTATION": "Module variable that changes",
    "CHECK_THEN_ACT_RACE": "Look-up and write that can interleave",
    "SILENT_ERROR": "Failure that nobody sees",
    "UNSAFE_IO": "Request whose failure is not handled",
    "STATEFUL_SERVICE": "Service that keeps state to itself",
    "PROTOTYPE_INFRA": "Infrastructure for trials only",
    "HARDCODED_SECRET": "Secret in the source",
    "UNSAFE_EVAL": "Text run as code",
    "HARDCODED_URL": "Address in the source",
    "BLOCKING_OPERATION": "Call that stops the event loop",
    "SCALING_RISK": "Load may outgrow this",
    "CONCURRENCY_RISK": "Parallel runs may collide",
    "RESILIENCE_GAP": "No way to go on after a fault",
    "OBSERVABILITY_GAP": "Too little is reported",
    "DATA_CONTRACT_RISK": "Data taken on trust",
    "ENVIRONMENT_ASSUMPTION": "Bound to one environment",
}


def is_rule_id(name: str) -> bool:
    """Case-sensitive."""
    return name in DEFAULT_LEVELS


def rule_table(spark: SparkSession) -> DataFrame:
    """rule_id, enabled, level, description, heavy, category, complex: one row a rule, small enough for any broadcast."""
    rows = [(r, True, lv, DESCRIPTIONS.get(r), r in HEAVY_KINDS, next((c for c, k in CATEGORIES.items() if r in k), None), r in COMPLEX_RULES) for r, lv in DEFAULT_LEVELS.items()]
    return spark.createDataFrame(rows, "rule_id string, enabled boolean, level string, description string, heavy boolean, category string, complex boolean")


def lookup(table: dict[str, object], key: Column, default: Column | None = None) -> Column:
    """table[key] as an expression over a literal map."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def severity_order(severity: Column) -> Column:
    return lookup(SEVERITY_ORDER, severity, F.lit(0))


def category(kind: Column) -> Column:
    """The first category that has the kind, or null."""
    out = None
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(kinds), name) if out is None else out.when(kind.isin(kinds), name)
    return out


def penalty(kind: Column, severity: Column, level: Column) -> Column:
    """Points that a finding costs, as an exact decimal; a missing level counts as error, an unknown severity as low."""
    heavy = kind.isin(HEAVY_KINDS)
    base = F.when(heavy, lookup(PENALTIES[True], severity, F.lit(4))).otherwise(lookup(PENALTIES[False], severity, F.lit(2)))
    return (base.cast("decimal(10,2)") * lookup({k: v for k, v in LEVEL_WEIGHT.items()}, F.coalesce(level, F.lit("error")), F.lit("1.0")).cast("decimal(4,2)")).cast("decimal(18,4)")
