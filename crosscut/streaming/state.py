"""Usage, limits and plans from hook events, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quota, limits and plan tiers.
MONTHLY_TOKENS, KEEP_DAYS = 5_000_000, 35
GENERAL_LIMIT, WEBHOOK_LIMIT, WINDOW = 100, 60, "60 seconds"
PLANS = [("free", 5_000_000, True, 50, True), ("pro", 5_000_000, True, 50, True), ("enterprise", 5_000_000, True, 200, True)]
ACTIONS = ["opened", "reopened", "synchronize"]


def tier(plan_name: Column) -> Column:
    n = F.lower(F.trim(plan_name))
    return F.when(n.contains("enterprise") | n.contains("team"), "enterprise").when(n.contains("pro") | n.contains("starter"), "pro").otherwise("free")


def route(events: DataFrame) -> DataFrame:
    """Adds the route of each hook event; null for those that nothing handles."""
    e = F.col("event")
    r = F.when((e == "pull_request") & F.col("action").isin(ACTIONS) & F.col("installation_id").isNotNull(), "analyze")
    r = r.when(e == "check_suite", "log").when(e == "installation", "baseline").when(e == "marketplace_purchase", "plan")
    return events.withColumn("route", r)


def monthly_usage(events: DataFrame, limit: int = MONTHLY_TOKENS) -> DataFrame:
    """(installation_id, month, tokens, exceeded). On a stream with a watermark of KEEP_DAYS, old months leave the state."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    x = events.groupBy("installation_id", month).agg(F.sum("tokens").alias("tokens"))
    return x.withColumn("exceeded", F.col("tokens") >= limit)


def rate_windows(events: DataFrame, limit: int = WEBHOOK_LIMIT, window: str = WINDOW, by: str = "installation_id") -> DataFrame:
    """(by, start, requests, rejected) for fixed windows: rejected counts what goes over the limit."""
    x = events.groupBy(by, F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    return x.select(by, F.col("w.start").alias("start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def latest_plans(events: DataFrame) -> DataFrame:
    """(installation_id, tier) after each installation's last purchase event that takes effect; a cancellation leaves no row.

    Pending changes do nothing. A max_by, so that a stream keeps one row an installation.
    """
    e = events.where("event = 'marketplace_purchase' and purchase in ('purchased', 'changed', 'cancelled')")
    t = F.when(F.col("purchase") != "cancelled", tier(F.col("plan_name")))
    x = e.groupBy("installation_id").agg(F.max(F.struct("ts", "event_id", t.alias("tier")))["tier"].alias("tier"))
    return x.where("tier is not null")


def plan_limits(installations: DataFrame, plans: DataFrame) -> DataFrame:
    """Each installation with its tier (free without one) and that tier's limits."""
    table = installations.sparkSession.createDataFrame(PLANS, "tier string, monthly_tokens long, llm_enabled boolean, max_files_per_pr int, baseline_enabled boolean")
    valid = F.coalesce(F.when(F.col("tier").isin([p[0] for p in PLANS]), F.col("tier")), F.lit("free"))
    return installations.join(plans, "installation_id", "left").withColumn("tier", valid).join(F.broadcast(table), "tier", "left")


def tier_usage(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """(tier, month, installations, tokens, exceeded): what the installations of each tier (plan_limits) used in a month, and how many of them reached their limit."""
    x = usage.select("installation_id", "month", "tokens").join(limits.select("installation_id", "tier", "monthly_tokens"), "installation_id")
    return x.groupBy("tier", "month").agg(F.count("*").alias("installations"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") >= F.col("monthly_tokens")).alias("exceeded"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream's events, each delivery once within the time that late ones are waited for."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_watermark(events: DataFrame, late: str = f"{KEEP_DAYS} days") -> DataFrame:
    return events.withWatermark("ts", late)


def first_hit_windows(events: DataFrame, limit: int = WEBHOOK_LIMIT, seconds: int = 60, by: str = "installation_id") -> DataFrame:
    """(by, start, requests): windows that begin with a caller's first request after the last window ended.

    For streams: keeps one window a caller in arbitrary state.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = f"{by} long, start timestamp, requests long"

    def run(key, frames, state: GroupState):
        import pandas as pd

        start, n = state.get if state.exists else (None, 0)
        done = []
        for f in frames:
            for ts in f["ts"].sort_values():
                if start is None or (ts - start).total_seconds() >= seconds:
                    if start is not None:
                        done.append((key[0], start, n))
                    start, n = ts, 0
                n += 1
        if start is not None:
            state.update((start, n))
        yield pd.DataFrame(done, columns=[by, "start", "requests"])

    return events.select(by, "ts").groupBy(by).applyInPandasWithState(run, out, "start timestamp, n long", "append", GroupStateTimeout.NoTimeout)
