"""What surrounds the analysis: signed deliveries, time limits, retries, model tiers and log lines, as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import COMPLEX_RULES
from ..functions.text import is_transient_error

# Limits and retry policy.
TIMEOUT_MS, WEBHOOK_TIMEOUT_MS, SHUTDOWN_MS = 30_000, 120_000, 10_000
MAX_RETRIES, BASE_DELAY_MS, JITTER_MS = 3, 1_000, 100
TIERS = {"finding": "fast", "complex": "reasoning", "summary": "balanced"}


def signature(payload: Column, secret: str) -> Column:
    """The value a signed delivery carries: sha256= and the HMAC of its payload, of built-in functions only."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(payload, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pad(0x5C), inner), 256))


def verified(deliveries: DataFrame, secret: str, payload_col: str = "payload", signature_col: str = "signature") -> DataFrame:
    """Adds valid: whether the delivery's signature is that of its payload; false without one."""
    return deliveries.withColumn("valid", F.coalesce(F.col(signature_col) == signature(F.col(payload_col), secret), F.lit(False)))


def timed_out(elapsed_ms: Column, webhook: Column) -> Column:
    """Whether a request took longer than its kind may."""
    return elapsed_ms > F.when(webhook, WEBHOOK_TIMEOUT_MS).otherwise(TIMEOUT_MS)


def retry_delay(attempt: Column, error: Column, jitter: Column) -> Column:
    """Milliseconds to wait after a failed attempt (from 0) before the next, or null if there is none.

    Only transient errors are tried again, MAX_RETRIES times at most; the wait doubles, and jitter (0 to 1) adds
    up to JITTER_MS.
    """
    again = is_transient_error(error) & (attempt < MAX_RETRIES)
    return F.when(again, F.lit(float(BASE_DELAY_MS)) * F.pow(F.lit(2.0), attempt) + jitter * JITTER_MS)


def model_tier(kind: Column) -> Column:
    """The tier of model that validates findings of a kind: reasoning for rules that need context."""
    return F.when(kind.isin(COMPLEX_RULES), TIERS["complex"]).otherwise(TIERS["finding"])


def log_lines(events: DataFrame, as_json: bool = True, level: str = "level", message: str = "message", at: str = "ts") -> DataFrame:
    """events with line: one JSON object (level, time, message, then all other columns), or a line of plain text."""
    rest = [c for c in events.columns if c not in (level, message, at)]
    when = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if as_json:
        line = F.to_json(F.struct(F.col(level).alias("level"), when.alias("timestamp"), F.col(message).alias("message"), *rest))
    else:
        fields = F.concat(F.lit(" "), F.to_json(F.struct(*rest))) if rest else F.lit("")
        line = F.concat(F.lit("["), when, F.lit("] "), F.upper(level), F.lit(" "), F.col(message), fields)
    return events.withColumn("line", line)
