"""Rankings, cards, health and registry reports over the domain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.schemas import POST_KINDS

RANKING = (F.desc_nulls_last, "total"), (F.desc, "size"), (F.desc, "created_at"), (F.asc, "id")


@dataclass(frozen=True)
class ClusterFilters:
    """Optional filters, all combined with AND; an unset one does not filter."""

    kinds: frozenset[str] | None = None
    sources: frozenset[str] | None = None
    min_score: float | None = None
    from_date: date | None = None
    to_date: date | None = None


def _ranking_order() -> list[Column]:
    return [direction(name) for direction, name in RANKING]


def visible(include_hidden: bool = False) -> Column:
    """Hidden clusters are dropped unless asked for; an unlabelled cluster is visible."""
    return F.lit(True) if include_hidden else ~F.col("feedback").eqNullSafe("hidden")


def cluster_members(pain: DataFrame, assignment: DataFrame) -> DataFrame:
    """Pains with their cluster."""
    return pain.join(assignment.select("id", "cluster_id"), "id")


def member_sources(members: DataFrame, post: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct ``(cluster_id, source name)`` pairs."""
    by_source = (
        members.select("cluster_id", "raw_post_id")
        .join(post.select(F.col("id").alias("raw_post_id"), "source_id"), "raw_post_id")
        .select("cluster_id", "source_id")
        .distinct()
    )
    names = source.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return by_source.join(names, "source_id").select("cluster_id", "source_name").distinct()


def rank_clusters(
    cluster: DataFrame,
    score: DataFrame,
    members: DataFrame,
    post: DataFrame,
    source: DataFrame,
    filters: ClusterFilters = ClusterFilters(),
    include_hidden: bool = False,
) -> DataFrame:
    """Clusters with score and source list: best score first, unscored last.

    Sources filter through a semi-join, so nothing fans out and nothing is grouped back; source lists are
    made for the members of clusters that pass the other filters only.
    """
    conditions = [visible(include_hidden)]
    if filters.kinds:
        wanted = F.array(*[F.lit(k) for k in sorted(filters.kinds)])
        conditions.append(F.arrays_overlap(F.map_keys("kind_mix"), wanted))
    if filters.min_score is not None:
        conditions.append(F.col("total") >= F.lit(filters.min_score))
    if filters.from_date is not None:
        conditions.append(F.col("created_at") >= F.lit(filters.from_date).cast("timestamp"))
    if filters.to_date is not None:
        conditions.append(F.col("created_at") < F.date_add(F.lit(filters.to_date), 1).cast("timestamp"))

    scored = cluster.join(
        score.select(F.col("cluster_id").alias("id"), "total"), "id", "left"
    )
    rows = scored.filter(reduce(lambda a, b: a & b, conditions))
    passing = rows.select(F.col("id").alias("cluster_id"))
    pairs = member_sources(members.join(passing, "cluster_id", "left_semi"), post, source)
    if filters.sources:
        chosen = pairs.filter(F.col("source_name").isin(*sorted(filters.sources)))
        rows = rows.join(chosen.select(F.col("cluster_id").alias("id")), "id", "left_semi")
    # Bounded by the length of the source registry: the pairs are distinct already.
    lists = pairs.groupBy(F.col("cluster_id").alias("id")).agg(F.array_sort(F.collect_set("source_name")).alias("sources"))
    empty = F.array().cast("array<string>")
    return (
        rows.join(lists, "id", "left")
        .withColumn("sources", F.coalesce("sources", empty))
        .orderBy(*_ranking_order())
    )


def cluster_card(
    cluster_id: str, cluster: DataFrame, score: DataFrame, members: DataFrame, post: DataFrame, source: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Header row and member rows of one cluster, members by id."""
    head = cluster.filter(F.col("id") == cluster_id).join(
        score.select(F.col("cluster_id").alias("id"), "total", "rationale_md", "quotes"), "id", "left"
    )
    return head, card_members(members.filter(F.col("cluster_id") == cluster_id), post, source)


def card_members(members: DataFrame, post: DataFrame, source: DataFrame) -> DataFrame:
    """Members with their post and source, ordered by cluster and member id."""
    posts = post.select(
        F.col("id").alias("raw_post_id"), "source_id", F.col("title").alias("post_title"),
        F.col("url").alias("post_url"), "kind", "published_at",
    )
    sources = source.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return (
        members.select("cluster_id", "id", "raw_post_id", "body", "audience", "quote")
        .join(posts, "raw_post_id")
        .join(sources, "source_id")
        .select(
            "cluster_id", "id", "body", "audience", "quote", "source_name",
            "post_title", "post_url", "kind", "published_at",
        )
        .orderBy("cluster_id", "id")
    )


def source_names_with_pains(source: DataFrame, post: DataFrame, pain: DataFrame) -> DataFrame:
    """Names of the sources that have at least one pain, in code-point order."""
    with_pain = post.join(pain.select(F.col("raw_post_id").alias("id")), "id", "left_semi")
    keys = with_pain.select(F.col("source_id").alias("id")).distinct()
    return source.join(keys, "id", "left_semi").select("name").distinct().orderBy("name")


def enabled_sources(source: DataFrame) -> DataFrame:
    return source.filter("enabled").select("name", "rate_limit_rps").orderBy("name")


def _post_health(post: DataFrame) -> DataFrame:
    failed = F.col("fetch_status") == "failed"
    return post.groupBy("source_id").agg(
        F.max(F.when(F.col("fetch_status") != "failed", F.col("created_at"))).alias("last_ok"),
        F.count_if(failed).alias("failed_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("suspect_short").alias("suspect_short_count"),
    )


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def source_health(source: DataFrame, post: DataFrame) -> DataFrame:
    """Health of every enabled source by name; one without posts counts zero."""
    counts = ("failed_count", "total_count", "suspect_short_count")
    joined = source.filter("enabled").select(F.col("id").alias("source_id"), "name").join(
        _post_health(post), "source_id", "left"
    )
    filled = joined.fillna(0, list(counts))
    return filled.select(
        "name", "last_ok", *counts, share(F.col("suspect_short_count"), F.col("total_count")).alias("suspect_share")
    ).orderBy("name")


def source_registry(source: DataFrame, post: DataFrame, pain: DataFrame) -> DataFrame:
    """Every source with post and pain counts.

    Posts and pains are counted apart, so a post with two pains is one post.
    """
    per_post = pain.groupBy(F.col("raw_post_id").alias("id")).agg(F.count(F.lit(1)).alias("pains"))
    pains = (
        post.select("id", "source_id").join(per_post, "id").groupBy("source_id").agg(F.sum("pains").alias("pain_count"))
    )
    joined = (
        source.select(F.col("id").alias("source_id"), "name", "enabled")
        .join(_post_health(post), "source_id", "left")
        .join(pains, "source_id", "left")
        .fillna(0, ["failed_count", "total_count", "pain_count"])
    )
    return joined.select(
        "name", "enabled", "last_ok", "failed_count", F.col("total_count").alias("post_count"), "pain_count"
    ).orderBy("name")


def table_status(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per table in one job; a table that is absent has a NULL count."""
    parts = []
    spark = SparkSession.active()
    for name, table in tables.items():
        if table is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(None).cast("bigint").alias("rows")))
        else:
            parts.append(table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def catalog_status(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return table_status({n: spark.table(n) if spark.catalog.tableExists(n) else None for n in names})


def cluster_facts(members: DataFrame, post: DataFrame) -> DataFrame:
    """Per cluster: distinct posts, distinct sources, first and last post.

    ``posts`` is the number the rubric prompt shows as its spread; ``sources`` counts feeds.
    """
    posts = post.select(F.col("id").alias("raw_post_id"), "source_id", F.col("created_at").alias("post_at"))
    # One row per (cluster, post) first: two plain aggregates instead of an expand per distinct.
    per_post = members.select("cluster_id", "raw_post_id").distinct().join(posts, "raw_post_id")
    per_source = per_post.groupBy("cluster_id", "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("post_at").alias("lo"), F.max("post_at").alias("hi")
    )
    return per_source.groupBy("cluster_id").agg(
        F.sum("n").alias("posts"),
        F.count(F.lit(1)).alias("sources"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
    )


def kind_mix(members_with_kind: DataFrame, key: str = "cluster_id", extra: Sequence[Column] = ()) -> DataFrame:
    """Size and kind histogram per cluster, in one aggregate over the closed set of kinds."""
    counted = members_with_kind.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"), *[F.count_if(F.col("kind") == k).alias(k) for k in POST_KINDS], *extra
    )
    pairs = F.create_map(*[x for k in POST_KINDS for x in (F.lit(k), F.col(k))])
    return counted.withColumn("kind_mix", F.map_filter(pairs, lambda k, v: v > 0))


def embedding_counts(pain: DataFrame) -> DataFrame:
    """Rows that have a vector and rows that wait for one."""
    return pain.agg(
        F.count("embedding").alias("skipped"), (F.count(F.lit(1)) - F.count("embedding")).alias("pending")
    )


def demand_checks(checks: DataFrame, cluster_id: str) -> DataFrame:
    """Phrase checks of one cluster, newest first."""
    return (
        checks.filter(F.col("cluster_id") == cluster_id)
        .select("phrase", "frequency", "checked_at")
        .orderBy(F.desc("checked_at"), "phrase")
    )


def score_band(scores: DataFrame, column: str = "score") -> DataFrame:
    """Sanity flag of a scoring pass: three or more scores within ten points of each other."""
    flag = (F.count(column) >= 3) & (F.max(column) - F.min(column) < 10)
    return scores.agg(
        F.count(column).alias("scored"),
        F.min(column).alias("lowest"),
        F.max(column).alias("highest"),
        F.coalesce(flag, F.lit(False)).alias("sanity_flag"),
    )


def regression_gate(posts: DataFrame, min_share: float = 0.8) -> DataFrame:
    """Labelled-data gate over ``(has_valid, hallucinated)`` rows."""
    rate = F.avg(F.col("has_valid").cast("double"))
    lies = F.coalesce(F.sum("hallucinated"), F.lit(0))
    return posts.agg(
        rate.alias("valid_share"),
        lies.alias("hallucinated"),
        F.coalesce((rate >= min_share) & (lies == 0), F.lit(False)).alias("passed"),
    )
