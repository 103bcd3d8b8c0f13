"""All stages in a row over published tables, and a second pass that changes nothing."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from sigmill import schemas
from sigmill.operators import encode, prompts
from workload.base import trigram_encoder
from sigmill.plans import ledger, reports, stages, tables
from sigmill.sources import landed

TEXTS = {
    "https://x.example/1?utm_source=feed": "Deliveries arrive late every single week, says the owner.",
    "https://x.example/1/": "a copy under the same canonical address",
    "https://x.example/2": "Our deliveries arrive late every week and nobody explains why.",
    "https://x.example/3": "The invoice form loses all typed numbers on save.",
    "https://x.example/4": "Nothing is wrong here.",
}
QUOTES = {"1": "Deliveries arrive late every", "2": "deliveries arrive late every", "3": "loses all typed numbers"}
BODIES = {"1": "deliveries arrive late every week", "2": "deliveries arrive late every week!", "3": "form loses typed numbers"}


def now(day):
    return F.lit(datetime(2026, 1, day))


def last_part(column):
    return F.regexp_extract(column, r"/(\d)$", 1)


def test_stages_in_a_row(spark, rows, tmp_path):
    source = spark.createDataFrame([("s1", "web", True)], "id string, name string, enabled boolean")
    folder = tmp_path / "source_name=web"
    folder.mkdir()
    (folder / "posts.json").write_text("\n".join(json.dumps({"url": u, "title": "t", "text": x, "kind": "complaint"}) for u, x in TEXTS.items()))
    gathered, warnings = landed.gather(spark, str(tmp_path), source)
    events = []

    def one_pass(day):
        if not spark.catalog.tableExists("e2e_post"):
            tables.append(spark.createDataFrame([], schemas.RAW_POST), "e2e_post", "id", 2)
            tables.publish(spark.createDataFrame([], schemas.PAIN), "e2e_pain", "id", 2)
            tables.publish(spark.createDataFrame([], schemas.SCORE), "e2e_score", "cluster_id", 2)
        collected = stages.collect(gathered, spark.table("e2e_post"), now(day), warnings)
        events.append(ledger.stage_event(collected.counters, f"run{day}", now(day), "collect"))
        counts = collected.counters.first().asDict()
        tables.append(collected.posts, "e2e_post", "id", 2)

        post, pain = spark.table("e2e_post"), spark.table("e2e_pain")
        pending = stages.pending_posts(post, pain)
        n = last_part("url_canon")

        def per_post(table):
            return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), n)

        entry = F.struct(per_post(BODIES).alias("body"), F.lit("shops").alias("audience"), per_post(QUOTES).alias("quote"))
        pains = F.when(n == "4", F.array().cast("array<struct<body:string,audience:string,quote:string>>")).otherwise(F.array(entry))
        answers = pending.filter(n.isin("1", "2", "3", "4")).select(
            F.col("id").alias("post_id"), F.to_json(F.struct(pains.alias("pains"))).alias("answer"),
            F.lit(100).alias("prompt_tokens"), F.lit(10).alias("completion_tokens"), F.lit("m").alias("model"), F.lit(False).alias("call_failed"),
        )
        prices = spark.createDataFrame([("m",)], "model string").withColumn("price_per_mtok", F.lit("1").cast("decimal(12,4)"))
        extracted = stages.extract(pending, answers, prices, "v1", now(day))
        counts |= extracted.counters.select("extracted", "cost_micro").first().asDict()
        with_vectors = encode.backfill_embeddings(pain.unionByName(extracted.pains), lambda: trigram_encoder(schemas.EMBEDDING_DIM))
        good, bad = schemas.split_valid(with_vectors, schemas.pain_rules())
        assert bad.isEmpty()
        tables.publish(good, "e2e_pain", "id", 2)

        clustered = stages.cluster(spark.table("e2e_pain"), post, now(day), threshold=0.7)
        tables.publish(clustered.clusters, "e2e_cluster", "id", 2)
        tables.publish(clustered.assignment, "e2e_pain_cluster", "id", 2)
        counts |= clustered.counters.first().asDict()
        members = reports.cluster_members(spark.table("e2e_pain"), spark.table("e2e_pain_cluster"))
        cluster = spark.table("e2e_cluster")

        todo = stages.unscored_clusters(cluster, spark.table("e2e_score"))
        parts = prompts.body_parts(members, "cluster_id", ["created_at", "id"])
        verdicts = parts.filter("part = 0").select(
            "cluster_id",
            F.to_json(F.struct((F.size("bodies") * 30).alias("score"), F.lit("why").alias("rationale_md"),
                               F.slice("bodies", 1, 1).alias("quotes"))).alias("answer"),
        )
        scored = stages.score(todo, verdicts, members.select("cluster_id", "body"), now(day))
        counts |= {"scored": scored.counters.first()["scored"]}
        tables.publish(spark.table("e2e_score").unionByName(scored.scores), "e2e_score", "cluster_id", 2)
        return counts, members

    first, members = one_pass(5)
    assert first == {
        "collected": 4, "skipped": 1, "warnings": 0, "extracted": 3, "cost_micro": 440,
        "pains": 3, "clusters_new": 2, "clusters_merged": 1, "singletons": 1, "without_vector": 0, "scored": 2,
    }
    ranking = reports.rank_clusters(spark.table("e2e_cluster"), spark.table("e2e_score"), members, spark.table("e2e_post"), source)
    shown = [(r["size"], float(r["total"]), r["kind_mix"], r["sources"]) for r in ranking.collect()]
    assert shown == [(2, 6.0, {"complaint": 2}, ["web"]), (1, 3.0, {"complaint": 1}, ["web"])]
    stored = {name: rows(spark.table(f"e2e_{name}").drop("created_at")) for name in ("post", "pain", "cluster", "pain_cluster", "score")}

    second, _ = one_pass(6)
    assert (second["collected"], second["skipped"], second["extracted"], second["scored"]) == (0, 5, 0, 0)
    for name, before in stored.items():
        assert rows(spark.table(f"e2e_{name}").drop("created_at")) == before
    runs = ledger.fold_runs(events[0].unionByName(events[1]))
    assert {r["run_id"]: r["stats"]["collected"] for r in runs.collect()} == {"run5": 4, "run6": 0}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "checks")
    spark.createDataFrame([("i", "c1", "p", 1, datetime(2026, 1, 1))], schemas.PHRASE_DEMAND).write.parquet(path)
    cluster = spark.createDataFrame([("c1", "t")], "id string, title string")
    stale = stages.stale_clusters(cluster, spark.read.parquet(path), F.lit(datetime(2026, 1, 9)))
    plan = stale._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(checked_at" in plan and "ReadSchema: struct<cluster_id:string,checked_at:timestamp>" in plan
    assert "LeftAnti" in plan


def test_bucketed_merge_does_not_shuffle_the_stored_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
        tables.publish(stored, "bucket_demo", key="k", buckets=4)
        changes = spark.createDataFrame([("5", "y")], "k string, v string")
        from sigmill.operators.merge import update_keyed

        merged = update_keyed(spark.table("bucket_demo"), changes, "k")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the changes only
        assert merged.filter("v = 'y'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
