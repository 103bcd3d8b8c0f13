"""Run ledger and versioned texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill import schemas
from sigmill.functions import text as tx
from sigmill.operators.ordering import dense_order_ids, with_rank_in_group
from sigmill.plans import ledger, versions
from sigmill.session import scratch_dir
from sigmill.streaming.jobs import ledger_stream, ledger_table_stream, stored_ledger, windowed_health
from workload.base import Tables, query, stamp

_STAGES = "string_agg(stage || '=' || status, ', ' ORDER BY stage)"
_STATS = "string_agg(counter || '=' || value, ', ' ORDER BY counter)"
_RUN = f"""
    SELECT r.run_id, strftime(r.started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
           strftime(r.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, r.cost, r.prompt_version_id,
           coalesce(g.stages, '') AS stages, coalesce(t.stats, '') AS stats
    FROM run_v r LEFT JOIN (SELECT run_id, {_STAGES} AS stages FROM stage_v GROUP BY run_id) g ON g.run_id = r.run_id
    LEFT JOIN (SELECT run_id, {_STATS} AS stats FROM stat_v GROUP BY run_id) t ON t.run_id = r.run_id
"""
_RUN_VIEWS = ("run_v", "stage_v", "stat_v")


def _pairs(name: str):
    entries = F.array_sort(F.map_entries(name))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", "
    ).alias(name)


def _flat(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id", stamp("started_at"), stamp("finished_at"), F.col("cost").cast("double").alias("cost"),
        "prompt_version_id", _pairs("stages"), _pairs("stats"),
    )


@query("run_ledger", _RUN, _RUN_VIEWS)
def run_ledger(t: Tables) -> DataFrame:
    return _flat(ledger.fold_runs(t.run_event))


def _forget_last_commit(t: Tables, checkpoint: str) -> None:
    """As if the job had been lost after writing its last batch and before noting so."""
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    last = max((f.getPath() for f in files.listStatus(path) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    files.delete(last, False)


@query("run_ledger_stream", _RUN, _RUN_VIEWS)
def run_ledger_stream(t: Tables) -> DataFrame:
    """The ledger kept by a stream that stops, resumes with more events and has to write its last batch again."""
    root = scratch_dir(t.spark, "ledger")
    checkpoint, events = f"{root}/checkpoint", t.run_event

    def run() -> None:
        stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/in")
        ledger_table_stream(stream, f"{root}/ledger", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for half in (0, 1):
        landed = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half)
        landed.repartition(4, "event_id").write.mode("append").parquet(f"{root}/in")
        run()
    _forget_last_commit(t, checkpoint)
    run()
    return _flat(stored_ledger(t.spark, f"{root}/ledger"))


@query("recent_runs", _RUN + " ORDER BY r.started_at DESC, r.run_id LIMIT 20", _RUN_VIEWS)
def recent_runs(t: Tables) -> DataFrame:
    return _flat(ledger.recent_runs(ledger.fold_runs(ledger.newest_events(t.run_event, 20)), 20))


@query(
    "active_runs",
    "SELECT DISTINCT run_id FROM stage_v WHERE status = 'running'",
    ("stage_v",),
)
def active_runs(t: Tables) -> DataFrame:
    return ledger.active_runs(ledger.fold_runs(t.run_event)).select("run_id")


@query(
    "latest_run",
    """SELECT r.run_id, (SELECT string_agg(stage || '=' || status, ', ' ORDER BY stage) FROM stage_v g
                         WHERE g.run_id = r.run_id) AS stages,
              coalesce((SELECT string_agg(counter || ': ' || value, ', ' ORDER BY CASE counter WHEN 'valid' THEN 0 ELSE 1 END)
                        FROM stat_v t WHERE t.run_id = r.run_id AND counter IN ('valid', 'hallucinated')), '') AS counters,
              CASE r.prompt_version_id WHEN 'pv0' THEN 'extract@1' WHEN 'pv1' THEN 'extract@2' END AS prompt
       FROM (SELECT * FROM run_v ORDER BY started_at DESC, run_id LIMIT 1) r""",
    _RUN_VIEWS,
)
def latest_run(t: Tables) -> DataFrame:
    return ledger.latest_run(ledger.fold_runs(ledger.newest_events(t.run_event, 1)), t.prompt_version)


_PROGRESS_KEYS = [
    (i, stage, j, key, ledger.COUNTER_LABELS[key])
    for i, (stage, keys) in enumerate(ledger.STAGE_COUNTERS.items())
    for j, key in enumerate(keys)
]


@query(
    "stage_progress",
    f"""SELECT r.run_id, k.position, CASE k.stage {' '.join(f"WHEN '{s}' THEN '{label}'" for s, label in ledger.STAGE_LABELS.items())} ELSE k.stage END AS stage,
               CASE WHEN g.status IS NULL THEN '— (не запускалась)' WHEN g.status = 'running' THEN 'выполняется'
                    WHEN g.status = 'done' THEN 'готово' WHEN g.status = 'error' THEN 'ошибка' ELSE g.status END AS status,
               coalesce(string_agg(k.label || ' ' || t.value, ', ' ORDER BY k.key_pos) FILTER (WHERE t.value IS NOT NULL),
                        '—') AS metrics
        FROM run_v r, (VALUES {', '.join(f"({i}, '{s}', {j}, '{k}', '{label}')" for i, s, j, k, label in _PROGRESS_KEYS)})
             AS k(position, stage, key_pos, counter, label)
        LEFT JOIN stage_v g ON g.run_id = r.run_id AND g.stage = k.stage
        LEFT JOIN stat_v t ON t.run_id = r.run_id AND t.counter = k.counter
        GROUP BY r.run_id, k.position, k.stage, g.status""",
    _RUN_VIEWS,
)
def stage_progress(t: Tables) -> DataFrame:
    return ledger.stage_progress(ledger.fold_runs(t.run_event))


@query(
    "recent_cost",
    "SELECT count(*) AS runs, round(sum(cost), 4) AS cost FROM (SELECT * FROM run_v ORDER BY started_at DESC, run_id LIMIT 20)",
    ("run_v",),
)
def recent_cost(t: Tables) -> DataFrame:
    total = ledger.total_cost(ledger.fold_runs(ledger.newest_events(t.run_event, 20)), 20)
    return total.select("runs", F.round(F.col("cost").cast("double"), 4).alias("cost"))


@query(
    "run_durations",
    """SELECT run_id, CAST(epoch(date_trunc('second', finished_at)) - epoch(date_trunc('second', started_at)) AS BIGINT) AS seconds
       FROM run_v WHERE finished_at IS NOT NULL""",
    ("run_v",),
)
def run_durations(t: Tables) -> DataFrame:
    runs = ledger.fold_runs(t.run_event).filter("finished_at IS NOT NULL")
    return runs.select("run_id", tx.duration_seconds(F.col("started_at"), F.col("finished_at")).alias("seconds"))


@query(
    "health_stream",
    """WITH e AS (SELECT event_type, value, ts, date_trunc('day', ts) AS d, event_id % 5 = 0 AS second FROM events),
            -- A row of the second landing is late if its day had ended when the first landing was done.
            m AS (SELECT max(ts) FILTER (WHERE NOT second) - INTERVAL 1 DAY AS w1, max(ts) - INTERVAL 1 DAY AS w2 FROM e)
       SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source, count(*) AS total_count,
              count(*) FILTER (WHERE value < 10) AS failed_count
       FROM e, m WHERE NOT (second AND d + INTERVAL 1 DAY <= w1) AND d + INTERVAL 1 DAY <= w2 GROUP BY ALL""",
)
def health_stream(t: Tables) -> DataFrame:
    """Health per day and source as a stream in append mode; a fifth of all events lands after its watermark has moved on."""
    root = scratch_dir(t.spark, "health")
    events = t.events.select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for landing in (F.col("event_id") % 5 != 0, F.col("event_id") % 5 == 0):
        events.filter(landing).write.mode("append").parquet(f"{root}/in")
        rows = t.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        out = windowed_health(rows, "ts", "event_type", F.col("value") < 10).writeStream.outputMode("append").format("parquet")
        out.option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").withColumn("window_start", stamp("window_start"))


@query(
    "health_by_day",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source,
              count(*) AS total_count, count(*) FILTER (WHERE value < 10) AS failed_count
       FROM events GROUP BY ALL""",
)
def health_by_day(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_health(rows, "ts", "event_type", F.col("value") < 10).withColumn("window_start", stamp("window_start"))


@query(
    "stage_ledger",
    """SELECT run_id, stage, arg_max(status, (ts, event_id)) AS status, CAST(sum(cost_delta) AS DOUBLE) AS cost, count(*) AS events
       FROM run_event_v GROUP BY run_id, stage""",
    ("run_event_v",),
)
def stage_ledger(t: Tables) -> DataFrame:
    return ledger_stream(t.run_event).withColumn("cost", F.col("cost").cast("double"))


@query("run_by_id", _RUN + " WHERE r.run_id = 7", _RUN_VIEWS)
def run_by_id(t: Tables) -> DataFrame:
    return _flat(ledger.run_by_id(ledger.fold_runs(t.run_event), 7))


_VERSIONS = """
    SELECT source AS name, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS version,
           text AS body, doc_id FROM documents
"""


def _versions(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("source").alias("name"), F.col("text").alias("body"), "doc_id")
    ranked = with_rank_in_group(docs, "name", ["doc_id"], "version")
    return ranked.withColumn("version", F.col("version").cast("int"))


@query(
    "latest_version",
    f"""SELECT name, max(version) AS version, md5(arg_max(body, version)) AS body_md5
        FROM ({_VERSIONS}) GROUP BY name""",
)
def latest_version(t: Tables) -> DataFrame:
    return versions.active_versions(_versions(t)).select("name", "version", F.md5("body").alias("body_md5"))


@query("version_names", f"SELECT DISTINCT name FROM ({_VERSIONS}) ORDER BY name")
def version_names(t: Tables) -> DataFrame:
    return versions.names(t.documents.select(F.col("source").alias("name")))


@query(
    "next_version",
    f"""SELECT n.name, CAST(coalesce(v.top, 0) + row_number() OVER (PARTITION BY n.name ORDER BY n.doc_id) AS INTEGER) AS version,
               md5(n.body) AS body_md5
        FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'fresh' ELSE source END AS name, text || '!' AS body, doc_id
              FROM documents) n
        LEFT JOIN (SELECT name, max(version) AS top FROM ({_VERSIONS}) GROUP BY name) v ON v.name = n.name""",
)
def next_version(t: Tables) -> DataFrame:
    new = t.documents.select(
        F.when(F.col("doc_id") % 9 == 0, "fresh").otherwise(F.col("source")).alias("name"),
        F.concat("text", F.lit("!")).alias("body"),
        "doc_id",
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = versions.next_versions(_versions(t), new, ["doc_id"], now)
    return rows.select("name", "version", F.md5("body").alias("body_md5"))


# Lines that are once in both versions, by their place in the old one, in the order of the new one; of these the longest
# rising run stays in place and the others have moved. ``tails`` are the least ends of rising runs of each length.
_RISING = "lambda tails, y: list_concat(list_filter(tails, lambda t: t < y[1]), y, tails[len(list_filter(tails, lambda t: t < y[1])) + 2:])"


@query(
    "version_delta",
    f"""WITH v AS ({_VERSIONS}),
        b AS (SELECT name, version, lag(version) OVER w AS previous_version, string_split(body, chr(10)) AS new_lines,
                     string_split(lag(body) OVER w, chr(10)) AS old_lines
              FROM v WINDOW w AS (PARTITION BY name ORDER BY version)),
        p AS (SELECT * FROM b WHERE previous_version IS NOT NULL),
        c AS (SELECT name, version, line, count(*) FILTER (WHERE new) AS n, count(*) FILTER (WHERE NOT new) AS o
              FROM (SELECT name, version, unnest(new_lines) AS line, true AS new FROM p
                    UNION ALL SELECT name, version, unnest(old_lines), false FROM p) GROUP BY ALL),
        d AS (SELECT name, version, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS dropped
              FROM c GROUP BY ALL),
        u AS (SELECT name, version, list([old_at] ORDER BY new_at) AS places
              FROM (SELECT name, version, list_position(new_lines, line) AS new_at, list_position(old_lines, line) AS old_at
                    FROM c JOIN p USING (name, version) WHERE n = 1 AND o = 1) GROUP BY ALL)
        SELECT name, version, previous_version, added, dropped,
               coalesce(len(places) - len(list_reduce(places, {_RISING})), 0) AS moved
        FROM p JOIN d USING (name, version) LEFT JOIN u USING (name, version)""",
)
def version_delta(t: Tables) -> DataFrame:
    return versions.line_delta(_versions(t)).select(
        "name", "version", "previous_version",
        F.size("added").cast("bigint").alias("added"), F.size("dropped").cast("bigint").alias("dropped"), "moved",
    )


@query(
    "time_ordered_ids",
    """SELECT event_id, printf('%012x', epoch_us(ts) // 1000) || substr(sha256('{"k0":"' || event_id || '","k1":"' || event_type || '"}'), 1, 20) AS id,
              row_number() OVER (ORDER BY epoch_us(ts) // 1000, sha256('{"k0":"' || event_id || '","k1":"' || event_type || '"}')) AS place
       FROM events""",
)
def time_ordered_ids(t: Tables) -> DataFrame:
    """Ids of all events, and the place of each in the order of the ids alone."""
    rows = t.events.select("event_id", schemas.time_ordered_id(F.col("ts").cast("timestamp"), F.col("event_id"), F.col("event_type")).alias("id"))
    return dense_order_ids(rows, ["id"], "place").select("event_id", "id", (F.col("place") + 1).alias("place"))


@query(
    "version_rollback",
    f"""SELECT name, CAST((SELECT max(version) FROM ({_VERSIONS}) WHERE name = 'src1') + 1 AS INTEGER) AS version,
               md5(body) AS body_md5, 'ui' AS source
        FROM ({_VERSIONS}) WHERE name = 'src1' AND version = 2""",
)
def version_rollback(t: Tables) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    row = versions.rollback(_versions(t), "src1", 2, now)
    return row.select("name", "version", F.md5("body").alias("body_md5"), "source")


@query(
    "version_register",
    f"""SELECT DISTINCT n.name, n.version FROM (SELECT lang AS name, CAST(doc_id AS INTEGER) AS version FROM documents
                                       UNION ALL SELECT source, CAST(doc_id % 60 AS INTEGER) FROM documents) n
        WHERE NOT EXISTS (SELECT 1 FROM ({_VERSIONS}) v WHERE v.name = n.name AND v.version = n.version)""",
)
def version_register(t: Tables) -> DataFrame:
    number = F.col("doc_id").cast("int")
    shipped = t.documents.select(F.col("lang").alias("name"), number.alias("version")).unionByName(
        t.documents.select(F.col("source").alias("name"), (number % 60).alias("version"))
    )
    return versions.register(_versions(t), shipped)


@query(
    "version_seed",
    "SELECT lang AS name, count(*) AS rows FROM documents WHERE lang NOT IN (SELECT source FROM documents) GROUP BY lang",
)
def version_seed(t: Tables) -> DataFrame:
    docs = t.documents
    number = F.col("doc_id").alias("version")
    shipped = docs.select(F.col("lang").alias("name"), number).unionByName(docs.select(F.col("source").alias("name"), number))
    seeded = versions.seed(docs.select(F.col("source").alias("name")), shipped)
    return seeded.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
