"""Vector and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import vectors as vx
from sigmill.operators.encode import backfill_embeddings, encode_texts
from sigmill.operators.counters import side_by_side
from sigmill.operators.leaders import DEFAULT_THRESHOLD, leader_clusters, nearest_leaders
from sigmill.plans import reports, stages
from workload.base import Tables, query, trigram_encoder

# The driver's random vectors are far apart; at the default 0.88 every point is its own leader.
THRESHOLD = 0.30

_UNIT = """
    SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
                 sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"""
# The sequential rule itself: one recursion step per point, carrying the leaders so far.
_LEADERS = f"""
    WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY vec_id) AS seq, vec_id, v FROM ({_UNIT})),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS leaders
        UNION ALL
        SELECT p.seq, CASE WHEN len(list_filter(walk.leaders, lambda l: list_dot_product(l.v, p.v) >= {THRESHOLD})) > 0
                           THEN walk.leaders ELSE list_append(walk.leaders, {{'id': p.vec_id, 'v': p.v}}) END
        FROM walk JOIN p ON p.seq = walk.seq + 1),
    leader AS (SELECT unnest(leaders).id AS id FROM (SELECT leaders FROM walk ORDER BY seq DESC LIMIT 1)),
    lead AS (SELECT p.* FROM p JOIN leader ON leader.id = p.vec_id),
    assigned AS (
        SELECT p.vec_id, coalesce(arg_max(lead.vec_id, (list_dot_product(lead.v, p.v), lead.seq)), p.vec_id) AS cluster_id,
               max(list_dot_product(lead.v, p.v)) AS similarity
        FROM p LEFT JOIN lead ON lead.seq < p.seq AND list_dot_product(lead.v, p.v) >= {THRESHOLD}
        GROUP BY p.vec_id)"""


# The library's default, at which nearly every random vector is a leader.
DEFAULT = DEFAULT_THRESHOLD
_LEADERS_DEFAULT = _LEADERS.replace(f">= {THRESHOLD}", f">= {DEFAULT}")

# The stage only sees pains whose post exists.
_LEADERS_OF_POSTS = _LEADERS.replace(
    f"v FROM ({_UNIT}))", f"v FROM ({_UNIT}) WHERE vec_id IN (SELECT doc_id FROM documents))"
)


def _clusters(t: Tables) -> DataFrame:
    return leader_clusters(t.embeddings, "vec_id", "embedding", ["vec_id"], THRESHOLD)


@query(
    "leader_clusters",
    _LEADERS + " SELECT vec_id, cluster_id, round(similarity, 6) AS similarity FROM assigned",
)
def leader_cluster_members(t: Tables) -> DataFrame:
    return _clusters(t).select(
        F.col("id").alias("vec_id"), "cluster_id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "leader_clusters_default",
    _LEADERS_DEFAULT + " SELECT vec_id, cluster_id, round(similarity, 6) AS similarity FROM assigned",
)
def leader_clusters_default(t: Tables) -> DataFrame:
    return leader_clusters(t.embeddings, "vec_id", "embedding", ["vec_id"]).select(
        F.col("id").alias("vec_id"), "cluster_id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "leader_cluster_sizes",
    _LEADERS + " SELECT cluster_id, count(*) AS size FROM assigned GROUP BY cluster_id",
)
def leader_cluster_sizes(t: Tables) -> DataFrame:
    return _clusters(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query(
    "cluster_stage",
    _LEADERS_OF_POSTS
    + """ SELECT count(*) AS pains, count(DISTINCT cluster_id) AS clusters_new,
                 count(*) - count(DISTINCT cluster_id) AS clusters_merged,
                 (SELECT count(*) FROM (SELECT cluster_id FROM assigned GROUP BY 1 HAVING count(*) = 1)) AS singletons,
                 CAST(0 AS BIGINT) AS without_vector
          FROM assigned""",
)
def cluster_stage(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return stages.cluster(t.pain.drop("cluster_id"), t.post, now, THRESHOLD).counters


@query(
    "cluster_recompute",
    _LEADERS.replace(f"v FROM ({_UNIT}))", f"v FROM ({_UNIT}) WHERE vec_id % 4 > 0 AND vec_id IN (SELECT doc_id FROM documents))")
    + """ SELECT count(*) AS pains, count(DISTINCT cluster_id) AS clusters_new,
                 (SELECT count(*) FROM embeddings WHERE vec_id % 4 = 0 AND vec_id IN (SELECT doc_id FROM documents)) AS without_vector,
                 (SELECT count(DISTINCT label) FROM embeddings WHERE label % 4 <> 0) AS scores_dropped,
                 count(DISTINCT cluster_id) AS unscored FROM assigned""",
)
def cluster_recompute(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    pain = t.pain.drop("cluster_id").withColumn("embedding", F.when(F.col("id") % 4 > 0, F.col("embedding")))
    out = stages.recompute(pain, t.post, t.score, now, THRESHOLD)
    unscored = stages.unscored_clusters(out.clusters, out.scores).agg(F.count(F.lit(1)).alias("unscored"))
    return side_by_side(out.counters.select("pains", "clusters_new", "without_vector", "scores_dropped"), unscored)


@query(
    "cluster_titles",
    _LEADERS_OF_POSTS
    + """ SELECT a.cluster_id AS id, 'cluster ' || max(CASE WHEN a.vec_id = a.cluster_id THEN k END) AS title, count(*) AS size,
                 concat_ws(', ', 'demand=' || nullif(count(*) FILTER (WHERE k = 'demand'), 0),
                           'complaint=' || nullif(count(*) FILTER (WHERE k = 'complaint'), 0),
                           'discussion=' || nullif(count(*) FILTER (WHERE k = 'discussion'), 0)) AS kinds
          FROM (SELECT vec_id, cluster_id, ['demand', 'complaint', 'discussion'][vec_id % 3 + 1] AS k FROM assigned) a
          GROUP BY a.cluster_id""",
)
def cluster_titles(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = stages.cluster(t.pain.drop("cluster_id"), t.post, now, THRESHOLD).clusters
    kinds = F.transform(F.map_entries("kind_mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("id", "title", "size", F.array_join(kinds, ", ").alias("kinds"))


@query(
    "nearest_leaders",
    f"""WITH p AS (SELECT vec_id, v FROM ({_UNIT}))
        SELECT p.vec_id, arg_max(l.vec_id, (list_dot_product(l.v, p.v), l.vec_id)) AS leader_id,
               round(max(list_dot_product(l.v, p.v)), 6) AS similarity
        FROM p LEFT JOIN p l ON l.vec_id < p.vec_id AND list_dot_product(l.v, p.v) >= 0.2 GROUP BY p.vec_id""",
)
def nearest_of_all(t: Tables) -> DataFrame:
    points = t.embeddings.select(F.col("vec_id").alias("seq"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest_leaders(points, points, 0.2)
    return found.select(F.col("id").alias("vec_id"), "leader_id", F.round("similarity", 6).alias("similarity"))


@query(
    "unit_vectors",
    f"""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
               round(u.v[1], 6) AS first, round(u.v[64], 6) AS last,
               round(list_dot_product(u.v, list_reverse(u.v)), 6) + 0.0 AS mirror
        FROM embeddings JOIN ({_UNIT}) u USING (vec_id)""",
)
def unit_vectors(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("v", vx.unit("embedding"))
    return rows.select(
        "vec_id", F.round(vx.norm("embedding"), 6).alias("norm"),
        F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"),
        (F.round(vx.dot("v", F.reverse("v")), 6) + F.lit(0.0)).alias("mirror"),
    )


@query(
    "vector_text",
    """SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 3) + 0.0 AS first,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 2) + 0.0 AS total,
              round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 3) AS norm FROM embeddings""",
)
def vector_text(t: Tables) -> DataFrame:
    # Written as text and read back; every number counts in the sums.
    back = t.embeddings.select("vec_id", vx.from_literal(vx.to_literal("embedding")).cast("array<double>").alias("copy"))
    total = F.aggregate("copy", F.lit(0.0), lambda a, x: a + x)
    return back.select(
        "vec_id", F.size("copy").cast("bigint").alias("dim"), (F.round(F.get("copy", F.lit(0)), 3) + 0.0).alias("first"),
        (F.round(total, 2) + 0.0).alias("total"), F.round(vx.norm("copy"), 3).alias("norm"),
    )


_TRIGRAMS = """
    SELECT doc_id, ((unicode(z[1]) * CAST(1000003 AS HUGEINT) + unicode(z[2])) * 1000003 + unicode(z[3])) % 64 AS bucket
    FROM (SELECT doc_id, unnest(list_zip(c[:-3], c[2:-2], c[3:])) AS z
          FROM (SELECT doc_id, string_split('passage: ' || text, '') AS c FROM documents))"""


@query(
    "encode_documents",
    f"""SELECT doc_id, max(n) FILTER (WHERE bucket = 5) IS NOT NULL AS has_five, count(*) AS filled,
               round(coalesce(max(n) FILTER (WHERE bucket = 5), 0) / sqrt(sum(n * n)), 4) AS five,
               round(sum(n * (bucket + 1)) / sqrt(sum(n * n)), 2) AS mass
        FROM (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS n FROM ({_TRIGRAMS}) GROUP BY ALL) GROUP BY doc_id""",
)
def encode_documents(t: Tables) -> DataFrame:
    vectors = encode_texts(t.documents, "doc_id", "text", lambda: trigram_encoder(64))
    five = F.get("embedding", F.lit(5)).cast("double")
    # All 64 numbers, each with its place.
    mass = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(
        "doc_id", (five > 0).alias("has_five"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("filled"), F.round(five, 4).alias("five"),
        F.round(mass, 2).alias("mass"),
    )


def _partly_embedded(t: Tables) -> DataFrame:
    body = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("body"))
    some = F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding")
    # Every document is a row; those that no vector belongs to wait for one too.
    return body.join(t.embeddings, "vec_id", "left").select(F.col("vec_id").alias("id"), "body", some)


@query(
    "embedding_counts",
    """SELECT count(*) FILTER (WHERE vec_id % 3 <> 0) AS skipped, count(*) FILTER (WHERE coalesce(vec_id % 3 = 0, true)) AS pending
       FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
)
def embedding_counts(t: Tables) -> DataFrame:
    return reports.embedding_counts(_partly_embedded(t))


@query(
    "embedding_backfill",
    f"""SELECT g.doc_id AS id, CASE WHEN e.vec_id % 3 <> 0 THEN round(CAST(e.embedding[6] AS DOUBLE), 4)
               ELSE round(coalesce(g.n, 0) / g.norm, 4) END AS sixth
        FROM embeddings e RIGHT JOIN (SELECT doc_id, max(n) FILTER (WHERE bucket = 5) AS n, sqrt(sum(n * n)) AS norm
            FROM (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS n FROM ({_TRIGRAMS}) GROUP BY ALL) GROUP BY doc_id) g
          ON g.doc_id = e.vec_id""",
)
def embedding_backfill(t: Tables) -> DataFrame:
    filled = backfill_embeddings(_partly_embedded(t), lambda: trigram_encoder(64))
    return filled.select("id", F.round(F.get("embedding", F.lit(5)).cast("double"), 4).alias("sixth"))
