"""The five stages as table-to-table jobs.

Each stage is a function from DataFrames to DataFrames plus its counters; writing is left to
``sigmill.plans.tables``. A rerun over unchanged inputs produces nothing new.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions import text as tx
from sigmill.operators import answers as an
from sigmill.operators import merge
from sigmill.operators.counters import side_by_side
from sigmill.operators.leaders import DEFAULT_THRESHOLD, leader_clusters
from sigmill.plans import reports
from sigmill.schemas import natural_id
from sigmill.session import cut

REVALIDATE_DAYS = 7
DEMAND_THRESHOLD = 100

# Fixed display texts of the confirmed-demand note.
DEMAND_MARKER = "Поисковый спрос подтверждён"
DEMAND_NOTE = (
    "\n\n**Поисковый спрос подтверждён** (Яндекс Wordstat: частотность "
    f"≥ {DEMAND_THRESHOLD}/мес по ключевой фразе)."
)


class Collected(NamedTuple):
    posts: DataFrame
    counters: DataFrame


def collect(posts: DataFrame, stored: DataFrame, now: Column, warnings: DataFrame | None = None) -> Collected:
    """New posts to append. The first occurrence of a canonical URL wins, stored ones first.

    The new posts are written down before anything is counted: appending them changes what is
    stored, and neither the rows nor the counters may follow that change. ``warnings`` has a row for each
    source that failed.
    """
    usable = posts.filter("url_canon IS NOT NULL")
    fresh, _ = merge.insert_if_absent(stored, usable, ["url_canon"], ["source_name", "seq"])
    rows = cut(
        fresh.select(
            natural_id(F.col("url_canon")).alias("id"),
            "source_id", "url_canon", "url", "title", "body", "kind", "published_at",
            F.lit("new").alias("fetch_status"),
            "suspect_short",
            now.alias("created_at"),
        ),
        "collected",
    )
    failed = rows.limit(0) if warnings is None else warnings
    counts = side_by_side(
        usable.agg(F.count(F.lit(1)).alias("offered")), rows.agg(F.count(F.lit(1)).alias("collected")),
        failed.agg(F.count(F.lit(1)).alias("warnings")),
    )
    counters = counts.select("collected", (F.col("offered") - F.col("collected")).alias("skipped"), "warnings")
    return Collected(rows, counters)


def pending_posts(post: DataFrame, pain: DataFrame, limit: int | None = None) -> DataFrame:
    """Posts that wait for extraction, oldest first; unbounded unless a batch size is given."""
    waiting = post.filter(F.coalesce("fetch_status", F.lit("new")).isin("new", "fetched")).join(
        pain.select(F.col("raw_post_id").alias("id")), "id", "left_anti"
    )
    if limit is None:
        return waiting
    return waiting.orderBy("created_at", "id").limit(limit)


class Extracted(NamedTuple):
    pains: DataFrame
    rejects: DataFrame
    statuses: DataFrame
    counters: DataFrame


def extract(
    pending: DataFrame,
    completions: DataFrame,
    prices: DataFrame,
    prompt_version_id: str,
    now: Column,
    max_pains: int = an.MAX_PAINS,
) -> Extracted:
    """Accepted pains, rejected entries, post statuses and counters.

    ``completions`` holds ``post_id, answer, prompt_tokens, completion_tokens, model,
    call_failed``. A post whose call failed keeps its status and is tried again by a later run.
    """
    price = prices.select("model", "price_per_mtok")
    joined = (
        pending.select(F.col("id").alias("post_id"), F.col("body").alias("text"))
        .join(completions, "post_id")
        .join(price, "model", "left")
    )
    # Written down once without the texts: every output is read from it.
    judged = cut(an.validate_extract(joined, max_pains=max_pains).drop("text", "answer"), "judged")
    answered = judged.filter("NOT call_failed")
    pains = an.accepted_pains(answered, "post_id").select(
        natural_id(F.col("raw_post_id"), F.lit(prompt_version_id), F.col("pos")).alias("id"),
        "raw_post_id", "body", "audience", "quote",
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(prompt_version_id).alias("prompt_version_id"),
        now.alias("created_at"),
    )
    statuses = answered.select(
        F.col("post_id").alias("id"), an.extract_status(F.col("parsed"), F.lit(False)).alias("fetch_status")
    )
    # An unparseable answer is not billed.
    cost = F.when(
        F.col("parsed") & ~F.col("call_failed"),
        an.token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_per_mtok")),
    )
    ok = ~F.col("call_failed")
    total = lambda name: F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).alias(name)
    counters = judged.agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.sum(F.when(ok, F.col("valid"))), F.lit(0)).alias("extracted"),
        F.count_if(ok & ~F.col("parsed")).alias("failed"),
        F.count_if("call_failed").alias("llm_errors"),
        *[total(name) for name in an.EXTRACT_COUNTERS],
        F.coalesce(F.sum(cost), F.lit(0).cast("decimal(28,10)")).alias("cost"),
    ).withColumn("cost_micro", an.micro_units(F.col("cost")))
    return Extracted(pains, an.rejected_pains(answered, "post_id"), statuses, counters)


class Clustered(NamedTuple):
    assignment: DataFrame
    clusters: DataFrame
    counters: DataFrame


def cluster(
    pain: DataFrame,
    post: DataFrame,
    now: Column,
    threshold: float = DEFAULT_THRESHOLD,
    order: Sequence[str] = ("created_at", "id"),
) -> Clustered:
    """A full recompute of the partition. A pain without a vector is in no cluster; it is counted as waiting.

    Cluster ids name the leader and may come back, so the scores of the old partition must go: ``recompute``.
    """
    kinds = post.select(F.col("id").alias("raw_post_id"), "kind")
    waiting = pain.filter("embedding IS NULL").join(kinds, "raw_post_id", "left_semi")
    # Written down once: assignment, clusters and counters are all read from it.
    members = cut(
        leader_clusters(pain.join(kinds, "raw_post_id"), "id", "embedding", order, threshold, keep=("kind",)), "members"
    )
    leader_kind = F.max(F.when(F.col("id") == F.col("cluster_id"), F.col("kind"))).alias("leader_kind")
    mixes = reports.kind_mix(members, extra=[leader_kind]).drop("demand", "complaint", "discussion")
    clusters = mixes.select(
        F.col("cluster_id").alias("id"),
        F.concat(F.lit("cluster "), F.col("leader_kind")).alias("title"),
        "size",
        "kind_mix",
        now.alias("created_at"),
        F.lit(None).cast("string").alias("feedback"),
        F.lit(False).alias("split_flag"),
    )
    counters = clusters.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("pains"),
        F.count(F.lit(1)).alias("clusters_new"),
        (F.coalesce(F.sum("size"), F.lit(0)) - F.count(F.lit(1))).alias("clusters_merged"),
        F.count_if(F.col("size") == 1).alias("singletons"),
    )
    counters = side_by_side(counters, waiting.agg(F.count(F.lit(1)).alias("without_vector")))
    return Clustered(members.select("id", "cluster_id", "similarity"), clusters, counters)


class Recomputed(NamedTuple):
    assignment: DataFrame
    clusters: DataFrame
    scores: DataFrame
    counters: DataFrame


def recompute(
    pain: DataFrame, post: DataFrame, score: DataFrame, now: Column, threshold: float = DEFAULT_THRESHOLD
) -> Recomputed:
    """``cluster`` with its cascade: the clusters replace the old ones and no score outlives them.

    ``scores`` is the next state of the score table, which is empty; every cluster waits for a new score.
    """
    found = cluster(pain, post, now, threshold)
    gone = score.agg(F.count(F.lit(1)).alias("scores_dropped"))
    return Recomputed(found.assignment, found.clusters, score.limit(0), side_by_side(found.counters, gone))


def unscored_clusters(cluster: DataFrame, score: DataFrame) -> DataFrame:
    return cluster.join(score.select(F.col("cluster_id").alias("id")), "id", "left_anti")


def unscored_summary(cluster: DataFrame, score: DataFrame, members: DataFrame, post: DataFrame) -> DataFrame:
    """Unscored clusters with their facts, oldest first. Only their own members are aggregated."""
    todo = unscored_clusters(cluster, score)
    own = members.join(todo.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    facts = reports.cluster_facts(own, post).withColumnRenamed("cluster_id", "id")
    return todo.join(facts, "id").orderBy("first_seen", "id")


class Scored(NamedTuple):
    scores: DataFrame
    rejects: DataFrame
    counters: DataFrame


def score(todo: DataFrame, answers: DataFrame, bodies: DataFrame, now: Column) -> Scored:
    """Scores for the clusters that have none yet.

    ``answers`` holds ``cluster_id, answer``; ``bodies`` holds ``cluster_id, body``. A rejected
    cluster stays unscored.
    """
    wanted = answers.join(todo.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    # Written down once: scores, rejects and counters are all read from it.
    judged = cut(an.ground_scores(an.parse_score(wanted), bodies), "scored")
    kept = judged.filter("reason IS NULL")
    scores = kept.select(
        natural_id(F.col("cluster_id")).alias("id"),
        "cluster_id",
        an.stored_score(F.col("score")).alias("total"),
        "rationale_md",
        "quotes",
        now.alias("created_at"),
    )
    band = (F.count("score") >= 3) & (F.max("score") - F.min("score") < 10)
    counters = judged.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count("score").alias("scored"),
        F.count("reason").alias("rejected"),
        F.coalesce(band, F.lit(False)).cast("bigint").alias("sanity_flag"),
    )
    return Scored(scores, judged.filter("reason IS NOT NULL").select("cluster_id", "reason"), counters)


def stale_clusters(cluster: DataFrame, checks: DataFrame, now: Column, days: int = REVALIDATE_DAYS) -> DataFrame:
    """Clusters without a recent demand check. A check exactly at the bound is still fresh."""
    fresh = checks.filter(F.col("checked_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return cluster.join(fresh.select(F.col("cluster_id").alias("id")), "id", "left_anti")


class Validated(NamedTuple):
    checks: DataFrame
    scores: DataFrame
    counters: DataFrame


def validate(
    stale: DataFrame, answers: DataFrame, frequencies: DataFrame, scores: DataFrame, checks: DataFrame, now: Column
) -> Validated:
    """Demand validation of stale clusters.

    ``frequencies`` holds ``phrase, frequency``; a phrase without a frequency is one API error
    and leaves no check. Returns the next state of the checks and of the annotated scores.
    """
    wanted = answers.join(stale.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    judged = cut(an.parse_phrases(wanted).drop("answer"), "phrases")
    phrases = judged.filter("reason IS NULL").select("cluster_id", F.explode("phrases").alias("phrase"))
    looked_up = cut(phrases.join(frequencies.select("phrase", "frequency"), "phrase", "left"), "looked-up")
    new_checks = looked_up.filter("frequency IS NOT NULL").select(
        natural_id(F.col("cluster_id"), F.col("phrase")).alias("id"),
        "cluster_id", "phrase", "frequency", now.alias("checked_at"),
    )
    next_checks = merge.upsert_last_wins(checks, new_checks, ["cluster_id", "phrase"], ["checked_at"])
    confirmed = confirmed_clusters(new_checks)
    noted = annotate_scores(scores, confirmed)
    updated = scores.join(confirmed, "cluster_id", "left_semi").filter(
        ~F.contains("rationale_md", F.lit(DEMAND_MARKER))
    )
    totals = looked_up.agg(
        F.count(F.lit(1)).alias("phrases"),
        F.count("frequency").alias("validated"),
        F.count_if(F.col("frequency").isNull()).alias("api_errors"),
    )
    counters = side_by_side(
        judged.agg(F.count(F.lit(1)).alias("clusters"), F.count("reason").alias("rejected")),
        totals,
        confirmed.agg(F.count(F.lit(1)).alias("demand_confirmed")),
        updated.agg(F.count(F.lit(1)).alias("rationale_updated")),
    ).select("clusters", "phrases", "validated", "rejected", "api_errors", "demand_confirmed", "rationale_updated")
    return Validated(next_checks, noted, counters)


def confirmed_clusters(checks: DataFrame, threshold: int = DEMAND_THRESHOLD) -> DataFrame:
    """Clusters with any phrase at the threshold or above."""
    return checks.groupBy("cluster_id").agg(F.max("frequency").alias("_top")).filter(
        F.col("_top") >= threshold
    ).select("cluster_id")


def annotate_scores(scores: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Append the demand note to the rationale of confirmed clusters, once."""
    marked = scores.join(confirmed.withColumn("_hit", F.lit(True)), "cluster_id", "left")
    text = F.col("rationale_md")
    return marked.select(
        *[
            F.when(F.col("_hit"), tx.append_once(text, DEMAND_MARKER, DEMAND_NOTE)).otherwise(text).alias(c)
            if c == "rationale_md"
            else F.col(c)
            for c in scores.columns
        ]
    )
