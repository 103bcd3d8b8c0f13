"""The run ledger: an append-only event table folded into one row per run.

Events carry deltas. Nothing is updated in place, so a replayed or lost task cannot corrupt a
counter; the fold is a plain aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions.expr import lookup
from sigmill.schemas import STAGES

# Counters shown per stage, in display order.
STAGE_COUNTERS = {
    "collect": ("collected", "skipped", "warnings"),
    "extract": ("processed", "extracted", "failed", "llm_errors", "hallucinated"),
    "cluster": ("pains", "clusters_new", "clusters_merged", "singletons"),
    "score": ("clusters", "scored", "rejected", "sanity_flag"),
}
# Fixed display labels.
COUNTER_LABELS = {
    "collected": "собрано",
    "skipped": "дубликаты URL",
    "warnings": "источники с ошибками",
    "processed": "обработано",
    "extracted": "извлечено",
    "failed": "брак",
    "llm_errors": "ошибки LLM",
    "hallucinated": "галлюцинации",
    "pains": "болей",
    "clusters_new": "новых кластеров",
    "clusters_merged": "присоединено",
    "singletons": "синглтонов",
    "clusters": "кластеров",
    "scored": "оценено",
    "rejected": "отклонено",
    "sanity_flag": "узкий разброс",
}
# Fixed display names; a stage without one is shown by its key.
STAGE_LABELS = {"collect": "Сбор", "extract": "Извлечение", "cluster": "Кластеризация", "score": "Скоринг"}
STATUS_LABELS = {"running": "выполняется", "done": "готово", "error": "ошибка"}
NOT_STARTED = "— (не запускалась)"
NO_COUNTERS = "—"
# Counters of the latest-run report.
LATEST_COUNTERS = (
    "valid", "hallucinated", "schema_invalid", "invalid_json", "degraded_parse", "extra_fields", "cost_micro",
)


def fold_stages(events: DataFrame) -> DataFrame:
    """Last status per run and stage."""
    return (
        events.filter("stage IS NOT NULL AND status IS NOT NULL")
        .groupBy("run_id", "stage")
        .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    )


def fold_stats(events: DataFrame) -> DataFrame:
    """Summed deltas per run and counter."""
    return (
        events.select("run_id", F.explode("stats_delta").alias("counter", "delta"))
        .groupBy("run_id", "counter")
        .agg(F.sum("delta").alias("value"))
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run: stages and stats as maps, summed cost, first pinned prompt version.

    The history is first folded to one row per run and stage, then to one per run: the maps are
    as long as the stage and counter lists, not as the event history.
    """
    when = F.struct("ts", "event_id")
    finish = F.col("stage").isNull() & (F.col("status") == "finished")
    pin = F.when(F.col("prompt_version_id").isNotNull(), F.struct("ts", "event_id", "prompt_version_id"))
    per_stage = events.groupBy("run_id", "stage").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), when)).alias("status"),
        F.min("ts").alias("lo"),
        F.max(F.when(finish, F.col("ts"))).alias("end"),
        F.sum("cost_delta").alias("cost"),
        F.min(pin).alias("pin"),
    )
    return _runs(per_stage, fold_stats(events))


def _runs(per_stage: DataFrame, stats: DataFrame) -> DataFrame:
    known = F.col("stage").isNotNull() & F.col("status").isNotNull()
    heads = per_stage.groupBy("run_id").agg(
        F.min("lo").alias("started_at"),
        F.max("end").alias("finished_at"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"),
        F.min("pin").alias("pin"),
        F.array_sort(F.collect_list(F.when(known, F.struct("stage", "status")))).alias("stages"),
    )
    stats = stats.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "value")))).alias("stats")
    )
    return heads.join(stats, "run_id", "left").select(
        "run_id",
        "started_at",
        "finished_at",
        "cost",
        F.col("pin.prompt_version_id").alias("prompt_version_id"),
        F.map_from_entries("stages").alias("stages"),
        F.coalesce("stats", F.create_map().cast("map<string,bigint>")).alias("stats"),
    )


def partial_runs(events: DataFrame) -> DataFrame:
    """What a batch of events adds to the ledger: one row per run and stage, from which ``fold_partials`` goes on."""
    when = F.struct("ts", "event_id")
    finish = F.col("stage").isNull() & (F.col("status") == "finished")
    pin = F.when(F.col("prompt_version_id").isNotNull(), F.struct("ts", "event_id", "prompt_version_id"))
    said = F.when(F.col("status").isNotNull(), when)
    heads = events.groupBy("run_id", "stage").agg(
        F.max_by("status", said).alias("status"), F.max(said).alias("status_at"), F.min("ts").alias("lo"),
        F.max(F.when(finish, F.col("ts"))).alias("end"), F.sum("cost_delta").alias("cost"), F.min(pin).alias("pin"),
    )
    counted = events.select("run_id", "stage", F.explode("stats_delta").alias("counter", "delta"))
    counted = counted.groupBy("run_id", "stage", "counter").agg(F.sum("delta").alias("value"))
    stats = counted.groupBy(F.col("run_id").alias("_run"), F.col("stage").alias("_stage")).agg(
        F.collect_list(F.struct("counter", "value")).alias("stats")
    )
    same = heads["run_id"].eqNullSafe(stats["_run"]) & heads["stage"].eqNullSafe(stats["_stage"])
    return heads.join(stats, same, "left").drop("_run", "_stage")


def fold_partials(parts: DataFrame) -> DataFrame:
    """The ledger of ``fold_runs`` from the partial rows of all batches, in any order."""
    per_stage = parts.groupBy("run_id", "stage").agg(
        F.max_by("status", "status_at").alias("status"), F.min("lo").alias("lo"), F.max("end").alias("end"),
        F.sum("cost").alias("cost"), F.min("pin").alias("pin"),
    )
    each = parts.select("run_id", F.explode("stats").alias("s"))
    return _runs(per_stage, each.groupBy("run_id", F.col("s.counter").alias("counter")).agg(F.sum("s.value").alias("value")))


def newest_events(events: DataFrame, limit: int = 20) -> DataFrame:
    """The events of the newest runs, so that a report over few runs folds only their events."""
    heads = events.groupBy("run_id").agg(F.min("ts").alias("started_at"))
    newest = heads.orderBy(F.desc("started_at"), "run_id").limit(limit)
    return events.join(newest.select("run_id"), "run_id", "left_semi")


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs. ``limit`` is the report's feature."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def is_running(stages: Column | str) -> Column:
    stages = F.col(stages) if isinstance(stages, str) else stages
    return F.exists(F.map_values(stages), lambda s: s == "running")


def active_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(is_running("stages"))


def has_active_run(runs: DataFrame) -> bool:
    return not active_runs(runs).isEmpty()


def stage_progress(runs: DataFrame) -> DataFrame:
    """One row per run and stage, in stage order: status label and the stage's counters.

    The four stages are a constant array exploded per run.
    """
    labels = lookup(COUNTER_LABELS)
    statuses = lookup(STATUS_LABELS)
    plan = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), F.array(*[F.lit(k) for k in keys]).alias("keys"))
            for stage, keys in STAGE_COUNTERS.items()
        ]
    )
    rows = runs.select("run_id", "stages", "stats", F.posexplode(plan).alias("position", "s"))
    status = F.try_element_at(F.col("stages"), F.col("s.stage"))
    present = F.filter("s.keys", lambda k: F.map_contains_key(F.col("stats"), k))
    text = F.array_join(
        F.transform(
            present,
            lambda k: F.concat(
                F.try_element_at(labels, k), F.lit(" "), F.try_element_at(F.col("stats"), k).cast("string")
            ),
        ),
        ", ",
    )
    return rows.select(
        "run_id",
        "position",
        F.coalesce(F.try_element_at(lookup(STAGE_LABELS), F.col("s.stage")), F.col("s.stage")).alias("stage"),
        F.when(status.isNull(), F.lit(NOT_STARTED))
        .otherwise(F.coalesce(F.try_element_at(statuses, status), status))
        .alias("status"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_COUNTERS)).alias("metrics"),
    )


def latest_run(runs: DataFrame, prompt_version: DataFrame) -> DataFrame:
    """The newest run: stages by name, the report's counters, the pinned ``name@version``."""
    newest = recent_runs(runs, 1)
    keys = F.array(*[F.lit(k) for k in LATEST_COUNTERS])
    pin = prompt_version.select(
        F.col("id").alias("prompt_version_id"), F.concat("name", F.lit("@"), F.col("version").cast("string")).alias("prompt")
    )

    def pairs(entries: Column, mark: str) -> Column:
        return F.array_join(
            F.transform(entries, lambda e: F.concat(e["key"], F.lit(mark), e["value"].cast("string"))), ", "
        )

    shown = F.transform(
        F.filter(keys, lambda k: F.map_contains_key(F.col("stats"), k)),
        lambda k: F.struct(k.alias("key"), F.try_element_at(F.col("stats"), k).alias("value")),
    )
    return newest.join(pin, "prompt_version_id", "left").select(
        "run_id",
        pairs(F.array_sort(F.map_entries("stages")), "=").alias("stages"),
        pairs(shown, ": ").alias("counters"),
        "prompt",
    )


def total_cost(runs: DataFrame, limit: int = 20) -> DataFrame:
    return recent_runs(runs, limit).agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def event(
    run_id: Column, ts: Column, stage: Column, status: Column, stats: Column, cost: Column, prompt_version_id: Column
) -> list[Column]:
    """Columns of one ledger event; the id is derived, so a replay writes the same event."""
    return [
        F.xxhash64(run_id, ts, stage, status).alias("event_id"),
        run_id.alias("run_id"),
        ts.alias("ts"),
        stage.alias("stage"),
        status.alias("status"),
        stats.cast("map<string,bigint>").alias("stats_delta"),
        cost.cast("decimal(18,6)").alias("cost_delta"),
        prompt_version_id.cast("string").alias("prompt_version_id"),
    ]


def stage_event(
    counters: DataFrame, run_id: str, ts: Column, stage: str, status: Column | str = "done",
    cost: Column | None = None, prompt_version_id: str | None = None,
) -> DataFrame:
    """One-row counters frame as one ledger event with a single true delta."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    stats = F.create_map(*[x for c in counters.columns if c != "cost" for x in (F.lit(c), F.col(c).cast("bigint"))])
    status = F.lit(status) if isinstance(status, str) else status
    spent = cost if cost is not None else F.col("cost") if "cost" in counters.columns else F.lit(0)
    return counters.select(
        *event(F.lit(run_id), ts, F.lit(stage), status, stats, spent, F.lit(prompt_version_id))
    )
