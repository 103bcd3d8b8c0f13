"""Query registry and the domain views that the driver tables stand in for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions import text as tx
from sigmill.plans.reports import kind_mix
from sigmill.session import configure, ship

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``views`` are the SQL views its oracle builds on, in order."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            head = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in _closure(views))
            ORACLES[name] = f"WITH {head}\n{sql}" if head else sql
        return fn

    return register


def _closure(views: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for view in views:
        for dep in (*_closure(SQL_DEPS.get(view, ())), view):
            if dep not in out:
                out.append(dep)
    return out


def stamp(col: str, alias: str | None = None):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(alias or col)


START = "2024-01-01 00:00:00"


def spread_words(n) -> Column:
    """``n`` words of the whole text, evenly apart."""
    words = F.split("text", " ")
    at = F.when(F.lit(n) > 0, F.sequence(F.lit(0), F.lit(n) - 1))
    picked = F.transform(at, lambda i: F.get(words, F.floor(i * F.size(words) / n).cast("int")))
    return F.coalesce(picked, F.array().cast("array<string>"))


def spread_words_sql(n: str) -> str:
    return f"[string_split(text, ' ')[1 + (i * len(string_split(text, ' '))) // {n}] for i in range(CAST({n} AS BIGINT))]"


def trigram_encoder(dim: int):
    """Counts of hashed character trigrams: stands in for a model, whose weights are not at hand."""

    def encode(texts: list[str]) -> np.ndarray:
        points = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) for t in texts]
        points = [np.pad(p, (0, max(0, 3 - len(p)))) for p in points]
        ends = np.cumsum([len(p) for p in points])
        every = np.concatenate(points)
        mixed = ((every[:-2] * 1000003 + every[1:-1]) * 1000003 + every[2:]) % np.uint64(dim)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in points])
        inside = np.ones(len(mixed), dtype=bool)
        for back in (1, 2):  # trigrams across two texts
            inside[ends[:-1] - back] = False
        at = row[:-2][inside] * dim + mixed[inside].astype(np.int64)
        return np.bincount(at, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)

    return encode


class Tables:
    """Driver tables of one folder, and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        ship(spark, "sigmill", "workload")
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def minutes_after_start(self, col: str):
        return F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + F.col(col) * 60)

    @property
    def source(self) -> DataFrame:
        names = self.documents.select(F.col("source").alias("name")).distinct()
        idle = self.spark.createDataFrame([("idle",)], "name string")
        return names.unionByName(idle).select(
            F.concat(F.lit("id-"), "name").alias("id"),
            "name",
            (F.col("name") != "src3").alias("enabled"),
            F.lit(1).cast("decimal(4,2)").alias("rate_limit_rps"),
        )

    @property
    def post(self) -> DataFrame:
        kinds = F.array(F.lit("demand"), F.lit("complaint"), F.lit("discussion"))
        return self.documents.join(self.labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("id-"), "source").alias("source_id"),
            F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"),
            F.concat(F.lit("https://posts.example/"), F.col("doc_id").cast("string")).alias("url"),
            F.col("text").alias("body"),
            F.get(kinds, (F.col("doc_id") % 3).cast("int")).alias("kind"),
            self.minutes_after_start("doc_id").alias("published_at"),
            F.when(F.col("toxic") == 1, "failed")
            .when(F.col("quality").isNotNull(), "extracted")
            .when(F.col("doc_id") % 5 == 0, F.lit(None))
            .otherwise("new")
            .alias("fetch_status"),
            tx.is_short("text").alias("suspect_short"),
            self.minutes_after_start("doc_id").alias("created_at"),
        )

    @property
    def pain(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("id"),
            F.col("vec_id").alias("raw_post_id"),
            F.concat(F.lit("pain "), F.col("vec_id").cast("string")).alias("body"),
            F.concat(F.lit("audience "), (F.col("vec_id") % 7).cast("string")).alias("audience"),
            F.concat(F.lit("quote "), (F.col("vec_id") % 17).cast("string")).alias("quote"),
            "embedding",
            self.minutes_after_start("vec_id").alias("created_at"),
            F.col("label").cast("bigint").alias("cluster_id"),
        )

    @property
    def members(self) -> DataFrame:
        return self.pain.drop("embedding")

    @property
    def cluster(self) -> DataFrame:
        joined = self.members.join(self.post.select(F.col("id").alias("raw_post_id"), "kind"), "raw_post_id")
        born = self.members.groupBy("cluster_id").agg(F.min("created_at").alias("created_at"))
        return (
            kind_mix(joined)
            .join(born, "cluster_id")
            .select(
                F.col("cluster_id").alias("id"),
                F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")).alias("title"),
                "size",
                "kind_mix",
                "created_at",
                F.when(F.col("cluster_id") == 7, "hidden").when(F.col("cluster_id") == 2, "interesting").alias("feedback"),
                (F.col("cluster_id") % 5 == 0).alias("split_flag"),
            )
        )

    @property
    def score(self) -> DataFrame:
        return (
            self.members.select("cluster_id")
            .distinct()
            .filter("cluster_id % 4 <> 0")
            .select(
                "cluster_id",
                ((F.col("cluster_id") * 37 % 100) / 10).cast("decimal(5,2)").alias("total"),
                F.concat(F.lit("rationale "), F.col("cluster_id").cast("string")).alias("rationale_md"),
                F.array(F.concat(F.lit("quote "), F.col("cluster_id").cast("string"))).alias("quotes"),
            )
        )

    @property
    def checks(self) -> DataFrame:
        """Phrase checks: three words of every document, its check day by cluster."""
        return self._checks(F.floor(F.col("doc_id") / 25).cast("bigint"))

    @property
    def dealt_checks(self) -> DataFrame:
        """The same with the documents dealt over twelve clusters, each of which grows with the table."""
        return self._checks(F.col("doc_id") % 12)

    def _checks(self, cluster: Column) -> DataFrame:
        phrase = F.array_join(spread_words(3), " ")
        return self.documents.select(
            cluster.alias("cluster_id"),
            phrase.alias("phrase"),
            tx.hash_bucket(phrase, 10_001).alias("frequency"),
            F.timestamp_seconds(
                F.unix_seconds(F.lit(START).cast("timestamp")) + cluster * 86400
            ).alias("checked_at"),
            F.col("doc_id").alias("seq"),
        )

    @property
    def run_event(self) -> DataFrame:
        stages = {"signup": "collect", "view": "extract", "click": "cluster", "purchase": "score", "error": "validate"}
        stage = F.lit(None).cast("string")
        for kind, name in stages.items():
            stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
        statuses = F.array(*[F.lit(s) for s in ("running", "done", "error", "done", "done")])
        names = F.array(*[F.lit(s) for s in ("collected", "processed", "pains", "scored", "valid", "hallucinated")])
        end = F.col("event_id") % 13 == 0
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.events.select(
            "event_id",
            F.col("user_id").alias("run_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(~end, stage).alias("stage"),
            F.when(end, "finished").otherwise(F.get(statuses, (F.col("event_id") % 5).cast("int"))).alias("status"),
            F.when(~end, F.create_map(F.get(names, (F.col("event_id") % 6).cast("int")), k)).alias("stats_delta"),
            F.col("value").cast("decimal(18,6)").alias("cost_delta"),
            F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("pv"), (F.col("event_id") % 3).cast("string"))).alias(
                "prompt_version_id"
            ),
        )

    @property
    def prompt_version(self) -> DataFrame:
        return self.spark.createDataFrame([("pv0", "extract", 1), ("pv1", "extract", 2)], "id string, name string, version int")


def _checks_sql(cluster: str) -> str:
    return f"""
        SELECT cluster_id, phrase, CAST(('0x' || substr(sha256(phrase), 1, 8)) AS BIGINT) % 10001 AS frequency,
               TIMESTAMP '2024-01-01' + to_days(CAST(cluster_id AS INTEGER)) AS checked_at, seq
        FROM (SELECT {cluster} AS cluster_id, doc_id AS seq, array_to_string({spread_words_sql("3")}, ' ') AS phrase
              FROM documents)"""


SQL_VIEWS = {
    "source_v": """
        SELECT 'id-' || name AS id, name, name <> 'src3' AS enabled
        FROM (SELECT DISTINCT source AS name FROM documents UNION ALL SELECT 'idle')""",
    "post_v": """
        SELECT d.doc_id AS id, 'id-' || d.source AS source_id, 'title ' || d.doc_id AS title,
               'https://posts.example/' || d.doc_id AS url, d.text AS body,
               CASE d.doc_id % 3 WHEN 0 THEN 'demand' WHEN 1 THEN 'complaint' ELSE 'discussion' END AS kind,
               TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
               CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality IS NOT NULL THEN 'extracted'
                    WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'new' END AS fetch_status,
               length(d.text) < 200 AS suspect_short
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "pain_v": """
        SELECT vec_id AS id, vec_id AS raw_post_id, 'pain ' || vec_id AS body, 'audience ' || vec_id % 7 AS audience,
               'quote ' || vec_id % 17 AS quote, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at,
               CAST(label AS BIGINT) AS cluster_id
        FROM embeddings""",
    "cluster_v": """
        SELECT p.cluster_id AS id, 'cluster ' || p.cluster_id AS title, count(*) AS size,
               count(*) FILTER (WHERE r.kind = 'demand') AS demand,
               count(*) FILTER (WHERE r.kind = 'complaint') AS complaint,
               count(*) FILTER (WHERE r.kind = 'discussion') AS discussion,
               min(p.created_at) AS created_at,
               CASE p.cluster_id WHEN 7 THEN 'hidden' WHEN 2 THEN 'interesting' END AS feedback,
               p.cluster_id % 5 = 0 AS split_flag
        FROM pain_v p JOIN post_v r ON r.id = p.raw_post_id GROUP BY p.cluster_id""",
    "score_v": """
        SELECT DISTINCT cluster_id, CAST((cluster_id * 37 % 100) / 10.0 AS DECIMAL(5,2)) AS total,
               'rationale ' || cluster_id AS rationale_md
        FROM pain_v WHERE cluster_id % 4 <> 0""",
    "check_v": _checks_sql("doc_id // 25"),
    "dealt_check_v": _checks_sql("doc_id % 12"),
    "run_event_v": """
        SELECT event_id, user_id AS run_id, ts,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE CASE event_type WHEN 'signup' THEN 'collect'
                   WHEN 'view' THEN 'extract' WHEN 'click' THEN 'cluster' WHEN 'purchase' THEN 'score'
                   WHEN 'error' THEN 'validate' END END AS stage,
               CASE WHEN event_id % 13 = 0 THEN 'finished' ELSE CASE event_id % 5 WHEN 0 THEN 'running'
                   WHEN 2 THEN 'error' ELSE 'done' END END AS status,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE ['collected','processed','pains','scored','valid',
                   'hallucinated'][event_id % 6 + 1] END AS counter,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS delta,
               CAST(value AS DECIMAL(18,6)) AS cost_delta,
               CASE WHEN event_id % 7 = 0 THEN 'pv' || event_id % 3 END AS prompt_version_id
        FROM events""",
    "run_v": """
        SELECT run_id, min(ts) AS started_at, max(ts) FILTER (WHERE stage IS NULL AND status = 'finished') AS finished_at,
               CAST(sum(cost_delta) AS DOUBLE) AS cost,
               arg_min(prompt_version_id, (ts, event_id)) FILTER (WHERE prompt_version_id IS NOT NULL)
                   AS prompt_version_id
        FROM run_event_v GROUP BY run_id""",
    "stage_v": """
        SELECT run_id, stage, arg_max(status, (ts, event_id)) AS status
        FROM run_event_v WHERE stage IS NOT NULL GROUP BY run_id, stage""",
    "stat_v": """
        SELECT run_id, counter, CAST(sum(delta) AS BIGINT) AS value
        FROM run_event_v WHERE counter IS NOT NULL GROUP BY run_id, counter""",
}
SQL_DEPS = {
    "cluster_v": ("pain_v", "post_v"),
    "score_v": ("pain_v",),
    "run_v": ("run_event_v",),
    "stage_v": ("run_event_v",),
    "stat_v": ("run_event_v",),
}
