"""Classification of fetch / inference outcomes into categories and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category names and the HTTP status the service answers with.
CATEGORIES = ["timeout", "connection", "not_found", "rate_limited", "forbidden",
              "unauthorized", "http_error", "empty", "ok"]
DEFAULT_ERROR_STATUS = {"fetch": 400, "duplicates": 400, "architecture": 400, "review": 502, "tests": 502}


def fetch_category(status="http_status", remaining="rate_remaining", error="error",
                   blank="body_blank") -> Column:
    """Order matters: transport errors, 404, 403 (rate limit when the
    remaining-calls header is exactly "0"), 401, any other status >= 400,
    blank body, else ok."""
    st, rem, err, bl = (F.col(x) if isinstance(x, str) else x for x in (status, remaining, error, blank))
    return (F.when(err == "timeout", "timeout")
            .when(err == "connection", "connection")
            .when(st == 404, "not_found")
            .when((st == 403) & (rem == "0"), "rate_limited")
            .when(st == 403, "forbidden")
            .when(st == 401, "unauthorized")
            .when(st >= 400, "http_error")
            .when(bl, "empty")
            .otherwise("ok"))


def service_status(category, stage: str = "fetch") -> Column:
    """Status the service returns: rate limit -> 429; fetch timeout ("too long
    to respond") -> 504; ok -> 200; anything else the stage's default
    (400 for fetch and architecture, 502 for review and tests).  A slow model
    is not a fetch timeout and keeps the stage default."""
    cat = F.col(category) if isinstance(category, str) else category
    default = DEFAULT_ERROR_STATUS[stage]
    timeout_status = 504 if stage == "fetch" else default
    return (F.when(cat == "ok", 200)
            .when(cat == "rate_limited", 429)
            .when(cat == "timeout", timeout_status)
            .otherwise(default))


def classify_outcomes(log: DataFrame, stage: str = "fetch") -> DataFrame:
    """Adds ``category`` and ``status`` to a fetch log."""
    return (log.withColumn("category", fetch_category())
            .withColumn("status", service_status("category", stage)))


def outcome_counts(log: DataFrame, stage: str = "fetch") -> DataFrame:
    """Rows per (category, status); a map-side combined aggregate."""
    return (classify_outcomes(log, stage).groupBy("category", "status")
            .agg(F.count(F.lit(1)).alias("n")))
