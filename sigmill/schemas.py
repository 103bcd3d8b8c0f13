"""Explicit schemas of the domain tables, value domains and row validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value domains.
POST_KINDS = ("demand", "complaint", "discussion")
FETCH_STATUSES = ("new", "fetched", "extracted", "failed")
FEEDBACK_LABELS = ("interesting", "hidden")
STAGES = ("collect", "extract", "cluster", "score", "validate")
STAGE_STATUSES = ("running", "done", "error")
EMBEDDING_DIM = 384

SOURCE = "id string, name string, created_at timestamp, enabled boolean, rate_limit_rps decimal(4,2)"
RAW_POST = (
    "id string, source_id string, url_canon string, url string, title string, body string, "
    "kind string, published_at timestamp, fetch_status string, suspect_short boolean, created_at timestamp"
)
PAIN = (
    "id string, raw_post_id string, body string, audience string, quote string, "
    "embedding array<float>, prompt_version_id string, created_at timestamp"
)
# Assignments are their own table: a recompute overwrites it and leaves `pain` alone.
PAIN_CLUSTER = "id string, cluster_id string, similarity double"
CLUSTER = (
    "id string, title string, size bigint, kind_mix map<string,bigint>, created_at timestamp, "
    "feedback string, split_flag boolean"
)
SCORE = (
    "id string, cluster_id string, total decimal(5,2), rationale_md string, "
    "quotes array<string>, created_at timestamp"
)
RUN_EVENT = (
    "event_id bigint, run_id string, ts timestamp, stage string, status string, "
    "stats_delta map<string,bigint>, cost_delta decimal(18,6), prompt_version_id string"
)
PROMPT_VERSION = "id string, name string, version int, body string, source string, created_at timestamp"
PHRASE_DEMAND = "id string, cluster_id string, phrase string, frequency bigint, checked_at timestamp"
MODEL_PRICE = "model string, price_per_mtok decimal(12,4), is_active boolean"

# Landed inputs.
LABELLED_POST = "url string, title string, text string, kind string, source string"
EXPECTED_PAINS = "post_url string, pains array<struct<body:string,audience:string,quote:string>>"
FEED_ITEM = "title string, link string, pubDate string, description string"
REVIEW = (
    "app_id string, reviewId string, userName string, content string, score string, "
    "thumbsUpCount int, at timestamp"
)
APP_LIST = "app_ids array<string>"


def natural_id(*parts: Column) -> Column:
    """Deterministic row id from a natural key (a random id would change on recomputation)."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def time_ordered_id(at: Column, *parts: Column) -> Column:
    """Deterministic row id that sorts by time: 48 bits of milliseconds, then 80 bits of the natural key's hash.

    Written as 32 hexadecimal digits, so that ids sort as text the way their times do. A missing time is the
    epoch; times before it are taken as it.
    """
    millis = F.greatest(F.coalesce(F.unix_millis(at), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    return F.concat(F.lpad(F.lower(F.hex(millis)), 12, "0"), F.substring(natural_id(*parts), 1, 20))


def raw_post_rules() -> dict[str, Column]:
    return {
        "url_canon": F.col("url_canon").isNotNull(),
        "kind": F.col("kind").isin(*POST_KINDS),
        "fetch_status": F.col("fetch_status").isNull() | F.col("fetch_status").isin(*FETCH_STATUSES),
    }


def pain_rules(dim: int = EMBEDDING_DIM) -> dict[str, Column]:
    return {"embedding": F.col("embedding").isNull() | (F.size("embedding") == dim)}


def cluster_rules() -> dict[str, Column]:
    return {
        "size": F.col("size") >= 0,
        "feedback": F.col("feedback").isNull() | F.col("feedback").isin(*FEEDBACK_LABELS),
    }


def score_rules() -> dict[str, Column]:
    return {"total": F.col("total").between(0, 10)}


def phrase_rules() -> dict[str, Column]:
    return {"frequency": F.col("frequency") >= 0}


def first_violation(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule a row breaks, in the given order; NULL when it keeps them all.

    A rule that evaluates to NULL counts as broken.
    """
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(F.coalesce(rule, F.lit(False)), reason).otherwise(F.lit(name))
    return reason


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``; rejects carry a ``reason`` column."""
    tagged = df.withColumn("reason", first_violation(rules))
    return tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL")
