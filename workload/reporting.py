"""Joins, rankings, health and registry reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import text as tx
from sigmill.operators import prompts
from sigmill.plans import reports, stages
from workload.base import Tables, query, stamp

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "pending_posts",
    """SELECT p.id, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
       FROM post_v p LEFT JOIN pain_v a ON a.raw_post_id = p.id
       WHERE a.id IS NULL AND coalesce(p.fetch_status, 'new') IN ('new', 'fetched')
       ORDER BY p.created_at, p.id LIMIT 50""",
    ("post_v", "pain_v"),
)
def pending_posts(t: Tables) -> DataFrame:
    return stages.pending_posts(t.post, t.pain, limit=50).select("id", stamp("created_at"))


@query(
    "pending_posts_all",
    """SELECT p.id FROM post_v p
       WHERE p.id NOT IN (SELECT raw_post_id FROM pain_v)
         AND coalesce(p.fetch_status, 'new') IN ('new', 'fetched')""",
    ("post_v", "pain_v"),
)
def pending_posts_all(t: Tables) -> DataFrame:
    return stages.pending_posts(t.post, t.pain).select("id")


@query(
    "unscored_cluster_summary",
    """SELECT c.id AS cluster_id, c.size, count(DISTINCT p.raw_post_id) AS posts, count(DISTINCT r.source_id) AS sources,
              strftime(min(r.created_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
              strftime(max(r.created_at), '%Y-%m-%d %H:%M:%S') AS last_seen
       FROM cluster_v c JOIN pain_v p ON p.cluster_id = c.id JOIN post_v r ON r.id = p.raw_post_id
       LEFT JOIN score_v s ON s.cluster_id = c.id
       WHERE s.cluster_id IS NULL GROUP BY c.id, c.size ORDER BY min(r.created_at), c.id""",
    ("cluster_v", "score_v"),
)
def unscored_cluster_summary(t: Tables) -> DataFrame:
    rows = stages.unscored_summary(t.cluster, t.score, t.members, t.post)
    return rows.select(F.col("id").alias("cluster_id"), "size", "posts", "sources", stamp("first_seen"), stamp("last_seen"))


@query(
    "cluster_body_parts",
    """SELECT cluster_id, part, count(*) AS n_bodies, md5(string_agg(body, chr(10) ORDER BY rk)) AS bodies_md5
       FROM (SELECT cluster_id, body, rk, CAST((rk - 1) // 16 AS INTEGER) AS part
             FROM (SELECT cluster_id, body, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, id) AS rk
                   FROM pain_v))
       GROUP BY cluster_id, part""",
    ("pain_v",),
)
def cluster_body_parts(t: Tables) -> DataFrame:
    parts = prompts.body_parts(t.members, "cluster_id", ["created_at", "id"], per_part=16)
    return parts.select(
        "cluster_id", "part", F.size("bodies").alias("n_bodies"), F.md5(F.array_join("bodies", "\n")).alias("bodies_md5")
    )


@query(
    "stale_clusters",
    """SELECT c.id FROM cluster_v c WHERE NOT EXISTS (
           SELECT 1 FROM check_v w WHERE w.cluster_id = c.id
              AND w.checked_at >= TIMESTAMP '2024-01-12' - INTERVAL 7 DAY)""",
    ("cluster_v", "check_v"),
)
def stale_clusters(t: Tables) -> DataFrame:
    now = F.lit("2024-01-12 00:00:00").cast("timestamp")
    return stages.stale_clusters(t.cluster, t.checks, now).select("id")


_RANKED = """
    SELECT c.id, c.title, c.size, c.demand, c.complaint, c.discussion, CAST(s.total AS DOUBLE) AS total,
           strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, c.feedback, c.split_flag,
           coalesce(n.sources, '') AS sources
    FROM cluster_v c LEFT JOIN score_v s ON s.cluster_id = c.id
    LEFT JOIN (SELECT cluster_id, string_agg(name, ',' ORDER BY name) AS sources FROM (
                  SELECT DISTINCT p.cluster_id, o.name FROM pain_v p JOIN post_v r ON r.id = p.raw_post_id
                  JOIN source_v o ON o.id = r.source_id) GROUP BY cluster_id) n ON n.cluster_id = c.id
"""
_RANK_ORDER = " ORDER BY s.total DESC NULLS LAST, c.size DESC, c.created_at DESC, c.id"
_RANK_VIEWS = ("source_v", "cluster_v", "score_v")


def _ranked(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(
        "id", "title", "size",
        *[F.coalesce(F.try_element_at("kind_mix", F.lit(k)), zero).alias(k) for k in ("demand", "complaint", "discussion")],
        F.col("total").cast("double").alias("total"), stamp("created_at"), "feedback", "split_flag",
        F.array_join("sources", ",").alias("sources"),
    )


def _rank(t: Tables, filters=reports.ClusterFilters(), include_hidden: bool = False) -> DataFrame:
    return _ranked(
        reports.rank_clusters(t.cluster, t.score, t.members, t.post, t.source, filters, include_hidden)
    )


@query("cluster_ranking", _RANKED + " WHERE c.feedback IS DISTINCT FROM 'hidden'" + _RANK_ORDER, _RANK_VIEWS)
def cluster_ranking(t: Tables) -> DataFrame:
    return _rank(t)


@query("cluster_ranking_with_hidden", _RANKED + _RANK_ORDER, _RANK_VIEWS)
def cluster_ranking_with_hidden(t: Tables) -> DataFrame:
    return _rank(t, include_hidden=True)


@query(
    "cluster_ranking_filtered",
    _RANKED
    + """ WHERE c.feedback IS DISTINCT FROM 'hidden' AND (c.demand > 0 OR c.complaint > 0)
          AND c.id IN (SELECT p.cluster_id FROM pain_v p JOIN post_v r ON r.id = p.raw_post_id
                       JOIN source_v o ON o.id = r.source_id WHERE o.name IN ('src0', 'src2'))
          AND s.total >= 3.0 AND c.created_at >= DATE '2024-01-01' AND c.created_at < DATE '2024-01-01' + INTERVAL 1 DAY"""
    + _RANK_ORDER,
    _RANK_VIEWS,
)
def cluster_ranking_filtered(t: Tables) -> DataFrame:
    filters = reports.ClusterFilters(
        kinds=frozenset({"demand", "complaint"}),
        sources=frozenset({"src0", "src2"}),
        min_score=3.0,
        from_date=date(2024, 1, 1),
        to_date=date(2024, 1, 1),
    )
    return _rank(t, filters)


@query(
    "cluster_cards",
    """SELECT p.cluster_id, p.id, p.body, p.audience, p.quote, o.name AS source_name, r.title AS post_title,
              r.url AS post_url, r.kind, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS published_at
       FROM pain_v p JOIN post_v r ON r.id = p.raw_post_id JOIN source_v o ON o.id = r.source_id
       ORDER BY p.cluster_id, p.id""",
    ("pain_v", "post_v", "source_v"),
)
def cluster_cards(t: Tables) -> DataFrame:
    rows = reports.card_members(t.members, t.post, t.source)
    return rows.withColumn("published_at", stamp("published_at"))


@query(
    "cluster_card_head",
    """SELECT c.id, c.title, c.size, CAST(s.total AS DOUBLE) AS total, s.rationale_md
       FROM cluster_v c LEFT JOIN score_v s ON s.cluster_id = c.id WHERE c.id = 3""",
    ("cluster_v", "score_v"),
)
def cluster_card_head(t: Tables) -> DataFrame:
    head, _ = reports.cluster_card(3, t.cluster, t.score, t.members, t.post, t.source)
    return head.select("id", "title", "size", F.col("total").cast("double").alias("total"), "rationale_md")


@query(
    "source_names_with_pains",
    """SELECT DISTINCT o.name FROM source_v o JOIN post_v r ON r.source_id = o.id
       JOIN pain_v p ON p.raw_post_id = r.id ORDER BY o.name""",
    ("source_v", "post_v", "pain_v"),
)
def source_names_with_pains(t: Tables) -> DataFrame:
    return reports.source_names_with_pains(t.source, t.post, t.pain)


@query("enabled_sources", "SELECT name, CAST(1 AS DOUBLE) AS rate FROM source_v WHERE enabled ORDER BY name", ("source_v",))
def enabled_sources(t: Tables) -> DataFrame:
    return reports.enabled_sources(t.source).select("name", F.col("rate_limit_rps").cast("double").alias("rate"))


# Posts per source, and pains per source, each counted on its own before sources are looked at.
_POSTS_BY_SOURCE = """
    SELECT source_id, count(*) AS posts, sum(CAST(fetch_status = 'failed' AS INT)) AS failed,
           sum(CAST(suspect_short AS INT)) AS short, max(CASE WHEN fetch_status = 'failed' OR fetch_status IS NULL THEN NULL
           ELSE created_at END) AS last_ok
    FROM post_v GROUP BY source_id"""
_PAINS_BY_SOURCE = """
    SELECT source_id, count(*) AS pains FROM post_v, pain_v WHERE raw_post_id = post_v.id GROUP BY source_id"""


@query(
    "source_health",
    f"""SELECT name, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok, CAST(coalesce(failed, 0) AS BIGINT) AS failed_count,
               coalesce(posts, 0) AS total_count, CAST(coalesce(short, 0) AS BIGINT) AS suspect_short_count,
               coalesce(CAST(short AS DOUBLE) / posts, 0.0) AS suspect_share
        FROM (SELECT * FROM source_v WHERE enabled) LEFT JOIN ({_POSTS_BY_SOURCE}) ON source_id = id ORDER BY name""",
    ("source_v", "post_v"),
)
def source_health(t: Tables) -> DataFrame:
    return reports.source_health(t.source, t.post).withColumn("last_ok", stamp("last_ok"))


@query(
    "source_registry",
    f"""SELECT name, enabled, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok,
               CAST(coalesce(failed, 0) AS BIGINT) AS failed_count, coalesce(posts, 0) AS post_count,
               coalesce(pains, 0) AS pain_count
        FROM source_v LEFT JOIN ({_POSTS_BY_SOURCE}) AS by_post ON by_post.source_id = id
             LEFT JOIN ({_PAINS_BY_SOURCE}) AS by_pain ON by_pain.source_id = id ORDER BY name""",
    ("source_v", "post_v", "pain_v"),
)
def source_registry(t: Tables) -> DataFrame:
    return reports.source_registry(t.source, t.post, t.pain).withColumn("last_ok", stamp("last_ok"))


@query(
    "table_status",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in DRIVER_TABLES)
    + " UNION ALL SELECT 'absent', CAST(NULL AS BIGINT)",
)
def table_status(t: Tables) -> DataFrame:
    tables: dict[str, DataFrame | None] = {n: getattr(t, n) for n in DRIVER_TABLES}
    return reports.table_status({**tables, "absent": None})


@query("kind_mix", "SELECT id AS cluster_id, size, demand, complaint, discussion FROM cluster_v", ("cluster_v",))
def kind_mix(t: Tables) -> DataFrame:
    kinds = t.post.select(F.col("id").alias("raw_post_id"), "kind")
    return reports.kind_mix(t.members.join(kinds, "raw_post_id")).drop("kind_mix")


@query(
    "kinds_label",
    """SELECT id, coalesce(nullif(concat_ws(', ', CASE WHEN demand > 0 THEN 'заказ ' || demand END,
              CASE WHEN complaint > 0 THEN 'жалоба ' || complaint END,
              CASE WHEN discussion > 0 THEN 'обсуждение ' || discussion END), ''), '—') AS label FROM cluster_v""",
    ("cluster_v",),
)
def kinds_label(t: Tables) -> DataFrame:
    return t.cluster.select("id", tx.kinds_label("kind_mix").alias("label"))


@query(
    "score_band",
    """SELECT count(score) AS scored, CAST(min(score) AS DOUBLE) AS lowest, CAST(max(score) AS DOUBLE) AS highest,
              count(score) >= 3 AND max(score) - min(score) < 10 AS sanity_flag
       FROM (SELECT total * 10 AS score FROM score_v)""",
    ("score_v",),
)
def score_band(t: Tables) -> DataFrame:
    # Scores as the model gives them, 0 to 100.
    return reports.score_band(t.score.select((F.col("total") * 10).alias("score")), "score").select(
        "scored", F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"),
        "sanity_flag",
    )


@query(
    "coverage_gate",
    """SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_right,
              count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both_sides
       FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def coverage_gate(t: Tables) -> DataFrame:
    from sigmill.operators.dedup import coverage

    return coverage(t.documents, t.labels, "doc_id")


@query(
    "regression_gate",
    """SELECT CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) AS valid_share,
              CAST(sum(toxic) AS BIGINT) AS hallucinated,
              CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) >= 0.8 AND sum(toxic) = 0 AS passed
       FROM labels""",
)
def regression_gate(t: Tables) -> DataFrame:
    return reports.regression_gate(
        t.labels.select((F.col("quality") == 1).alias("has_valid"), F.col("toxic").alias("hallucinated"))
    )
