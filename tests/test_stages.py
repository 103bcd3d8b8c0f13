from __future__ import annotations

import json
import random
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sigmill import schemas
from sigmill.operators import merge
from sigmill.operators.merge import UnknownKeyError
from sigmill.plans import ledger, providers, reports, snapshots, stages, tables, versions
from sigmill.sources import landed
from sigmill.streaming import jobs

NOW = datetime(2026, 1, 10)


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(scope="module")
def seed(spark):
    """Six clusters over three feeds, among them a tie in score, a hidden one and one without a score."""
    source = spark.createDataFrame(
        [("f1", "north", True), ("f2", "south", True), ("f3", "east", False), ("f4", "quiet", True)], "id string, name string, enabled boolean"
    ).withColumn("rate_limit_rps", F.lit(2).cast("decimal(4,2)"))
    spec = [  # id, total, kinds, sources of its pains, created_at, feedback
        ("k1", 7.25, {"complaint": 2, "discussion": 1}, ["f1", "f3", "f3"], datetime(2026, 3, 2, 8), None),
        ("k2", 7.25, {"demand": 4}, ["f2", "f2", "f1", "f1"], datetime(2026, 3, 4), "interesting"),
        ("k3", 8.6, {"demand": 1}, ["f1"], datetime(2026, 3, 3, 23, 59, 59), "hidden"),
        ("k4", 0.0, {"discussion": 2}, ["f2", "f3"], datetime(2026, 3, 3), None),
        ("k5", 3.4, {"complaint": 1}, ["f3"], datetime(2026, 2, 11), None),
        ("k6", None, {"demand": 1, "discussion": 1}, ["f1", "f2"], datetime(2026, 3, 5), None),
    ]
    clusters, scores, posts, pains = [], [], [], []
    for cid, total, kinds, sources, created, feedback in spec:
        clusters.append((cid, f"cluster {cid}", len(sources), kinds, created, feedback, False))
        if total is not None:
            scores.append((cid, total, "why", ["q"]))
        for n, sid in enumerate(sources):
            pid = f"{cid}-{n}"
            posts.append((pid, sid, "t", f"https://p/{pid}", "text", next(iter(kinds)), created, "extracted", n == 1, created))
            pains.append((f"pain-{pid}", pid, f"body {pid}", "a", "q", cid, created))
    return {
        "source": source,
        "cluster": spark.createDataFrame(clusters, schemas.CLUSTER),
        "score": spark.createDataFrame(scores, "cluster_id string, total double, rationale_md string, quotes array<string>")
        .withColumn("total", F.col("total").cast("decimal(5,2)")),
        "post": spark.createDataFrame(
            posts, "id string, source_id string, title string, url string, body string, kind string, "
            "published_at timestamp, fetch_status string, suspect_short boolean, created_at timestamp"),
        "members": spark.createDataFrame(
            pains, "id string, raw_post_id string, body string, audience string, quote string, cluster_id string, created_at timestamp"),
    }


def ranked(seed, filters=reports.ClusterFilters(), include_hidden=False):
    frame = reports.rank_clusters(seed["cluster"], seed["score"], seed["members"], seed["post"], seed["source"], filters, include_hidden)
    return [(r["id"], r["sources"]) for r in frame.collect()]


def test_ranking(seed):
    order = ranked(seed)
    assert {c for c, _ in order[:2]} == {"k1", "k2"} and [c for c, _ in order[2:]] == ["k5", "k4", "k6"]
    assert dict(order) == {"k1": ["east", "north"], "k2": ["north", "south"], "k4": ["east", "south"], "k5": ["east"], "k6": ["north", "south"]}
    assert [c for c, _ in ranked(seed, include_hidden=True)][0] == "k3"


@pytest.mark.parametrize(
    ("filters", "wanted"),
    [
        (reports.ClusterFilters(kinds=frozenset({"complaint"})), {"k1", "k5"}),
        (reports.ClusterFilters(kinds=frozenset({"complaint", "demand"})), {"k1", "k2", "k5", "k6"}),
        (reports.ClusterFilters(sources=frozenset({"south"})), {"k2", "k4", "k6"}),
        (reports.ClusterFilters(min_score=3.4), {"k1", "k2", "k5"}),
        (reports.ClusterFilters(min_score=0.0), {"k1", "k2", "k4", "k5"}),
        (reports.ClusterFilters(from_date=date(2026, 3, 3), to_date=date(2026, 3, 4)), {"k2", "k4"}),
        (reports.ClusterFilters(to_date=date(2026, 2, 28)), {"k5"}),
        (reports.ClusterFilters(sources=frozenset({"east", "south"}), kinds=frozenset({"discussion"}), min_score=0.0), {"k1", "k4"}),
        (reports.ClusterFilters(sources=frozenset({"quiet"})), set()),
    ],
)
def test_ranking_filters(seed, filters, wanted):
    assert {c for c, _ in ranked(seed, filters)} == wanted


def test_card(seed, rows):
    head, members = reports.cluster_card("k4", seed["cluster"], seed["score"], seed["members"], seed["post"], seed["source"])
    assert rows(head, "id", "rationale_md") == [("k4", "why")]
    assert rows(members, "id", "source_name") == [("pain-k4-0", "south"), ("pain-k4-1", "east")]
    missing, _ = reports.cluster_card("zz", seed["cluster"], seed["score"], seed["members"], seed["post"], seed["source"])
    assert missing.isEmpty()


def test_health_and_registry(spark, rows):
    source = spark.createDataFrame([("1", "a", True), ("2", "b", True), ("3", "c", False)], "id string, name string, enabled boolean")
    post = spark.createDataFrame(
        [("p1", "1", "extracted", True, datetime(2026, 1, 1)), ("p2", "1", "failed", False, datetime(2026, 1, 3)),
         ("p3", "1", "new", False, datetime(2026, 1, 2)), ("p4", "3", None, False, datetime(2026, 1, 4))],
        "id string, source_id string, fetch_status string, suspect_short boolean, created_at timestamp",
    )
    pain = spark.createDataFrame([("x", "p1"), ("y", "p1"), ("z", "p4")], "id string, raw_post_id string")
    assert rows(reports.source_health(source, post)) == [
        ("a", datetime(2026, 1, 2), 1, 3, 1, pytest.approx(1 / 3)), ("b", None, 0, 0, 0, 0.0)]
    # A post with two pains is one post.
    assert rows(reports.source_registry(source, post, pain)) == [
        ("a", True, datetime(2026, 1, 2), 1, 3, 2), ("b", True, None, 0, 0, 0), ("c", False, None, 0, 1, 1)]
    assert [r["name"] for r in reports.source_names_with_pains(source, post, pain).collect()] == ["a", "c"]


def events(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    return spark.createDataFrame(
        [(1, "r1", t(1), "collect", "running", {"collected": 2}, 1.0, None), (2, "r1", t(2), "collect", "done", {"collected": 3, "skipped": 1}, 0.5, "v1"),
         (3, "r1", t(3), "extract", "error", {}, None, "v2"), (4, "r1", t(4), None, "finished", None, None, None),
         (5, "r2", t(5), "validate", "running", None, None, None)],
        "event_id bigint, run_id string, ts timestamp, stage string, status string, stats_delta map<string,bigint>, cost_delta double, prompt_version_id string",
    ).withColumn("cost_delta", F.col("cost_delta").cast("decimal(18,6)"))


def test_ledger(spark, rows):
    runs = ledger.fold_runs(events(spark))
    got = {r["run_id"]: r for r in runs.collect()}
    assert got["r1"]["stages"] == {"collect": "done", "extract": "error"}
    assert got["r1"]["stats"] == {"collected": 5, "skipped": 1}
    assert (float(got["r1"]["cost"]), got["r1"]["prompt_version_id"]) == (1.5, "v1")
    assert got["r1"]["finished_at"] == datetime(2026, 1, 1, 4) and got["r2"]["finished_at"] is None
    assert (got["r2"]["stages"], got["r2"]["stats"]) == ({"validate": "running"}, {})
    # Any stage counts, validate included.
    assert rows(ledger.active_runs(runs), "run_id") == [("r2",)] and ledger.has_active_run(runs)
    assert [r["run_id"] for r in ledger.recent_runs(runs, 1).collect()] == ["r2"]
    progress = {r["stage"]: (r["status"], r["metrics"]) for r in ledger.stage_progress(runs).filter("run_id = 'r1'").collect()}
    assert progress == {
        "Сбор": ("готово", "собрано 5, дубликаты URL 1"), "Извлечение": ("ошибка", "—"),
        "Кластеризация": ("— (не запускалась)", "—"), "Скоринг": ("— (не запускалась)", "—")}


def test_versions(spark, rows):
    stored = spark.createDataFrame([("p", 1, "a\nb", "file"), ("p", 2, "a\nc", "ui"), ("q", 1, "x", "file")], "name string, version int, body string, source string")
    stored = stored.withColumn("id", F.lit("i")).withColumn("created_at", at("2026-01-01")).select("id", "name", "version", "body", "source", "created_at")
    assert rows(versions.active_versions(stored), "name", "version", "body") == [("p", 2, "a\nc"), ("q", 1, "x")]
    new = spark.createDataFrame([("p", "n1", 1), ("p", "n2", 2), ("r", "z", 1)], "name string, body string, seq int")
    added = versions.next_versions(stored, new, ["seq"], at("2026-01-02"))
    assert rows(added, "name", "version", "body") == [("p", 3, "n1"), ("p", 4, "n2"), ("r", 1, "z")]
    back = versions.rollback(stored, "p", 1, at("2026-01-02"))
    assert rows(back, "name", "version", "body", "source") == [("p", 3, "a\nb", "ui")]
    with pytest.raises(UnknownKeyError):
        versions.rollback(stored, "p", 9, at("2026-01-02"))
    shipped = spark.createDataFrame([("p", 1, "new text"), ("p", 5, "five"), ("s", 1, "seed")], "name string, version int, body string")
    assert rows(versions.register(stored, shipped)) == [("p", 5, "five"), ("s", 1, "seed")]
    assert rows(versions.seed(stored, shipped), "name") == [("s",)]
    assert rows(versions.line_delta(stored)) == [("p", 2, 1, ["c"], ["b"], 0)]


FEED = """<?xml version="1.0"?><rss><channel>
<item><title>One &amp;amp; only</title><link> https://p.example/1/?utm_source=rss&amp;id=2 </link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>
<item><title><![CDATA[Two]]></title><link>https://p.example/2</link><pubDate>Mon, 05 Jan 2026 13:00:00 +0300</pubDate></item>
<item><title>No link</title><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>
<item><link>https://p.example/3</link><pubDate>nonsense</pubDate></item>
</channel></rss>"""


def test_feeds(spark, rows, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED, encoding="utf-8")
    loose = landed.feed_items(spark, str(tmp_path), require_title=False, double_escaped=True)
    assert rows(loose, "title", "link", "published_at") == sorted([
        ("One & only", "https://p.example/1/?utm_source=rss&id=2", datetime(2026, 1, 5, 10)),
        ("Two", "https://p.example/2", datetime(2026, 1, 5, 10)), ("", "https://p.example/3", None)], key=repr)
    items = landed.feed_items(spark, str(tmp_path), require_title=True)
    assert rows(items, "title") == [("One &amp; only",), ("Two",)]
    pages = spark.createDataFrame(
        [("https://p.example/1?id=2", "<body>" + "word " * 60 + "</body>"), ("https://p.example/2/", "<body></body>")], "url string, html string")
    posts = landed.feed_posts(items, pages, "discussion", cutoff=datetime(2026, 1, 5, 10))
    assert rows(posts, "url_canon", "kind", "suspect_short") == [("https://p.example/1?id=2", "discussion", False)]
    assert landed.feed_posts(items, pages, "discussion", cutoff=datetime(2026, 1, 5, 10), inclusive=False).isEmpty()


def test_malformed_feeds(spark, rows, tmp_path):
    cut_off = FEED.split("<item><title><![CDATA[Two")[0] + "<item><title>Broken</title><link>https://p.example/9"
    (tmp_path / "feed.xml").write_text(cut_off, encoding="utf-8")
    loose = landed.feed_items(spark, str(tmp_path), require_title=True)
    assert ("Broken",) not in rows(loose, "title")
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        landed.feed_items(spark, str(tmp_path), require_title=True, strict=True).collect()


def review(rid, score, content="bad", day=5, app="app"):
    return {"app_id": app, "reviewId": rid, "userName": "u", "content": content, "score": score, "at": f"2026-01-{day:02d}T00:00:00Z"}


def test_reviews(spark, rows, tmp_path):
    given = [review("a", 1), review("a", 2, "again"), review("b", 3, day=1), review("c", 4), review("d", 0), review("e", 2, "  "),
             review("", 1), review("f", 2.5), {"app_id": "app", "reviewId": "g", "content": "undated", "score": 1}, review("a", 1, app="other")]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in given))
    frame = landed.reviews(spark, str(tmp_path / "r.json"))
    base = "https://play.google.com/store/apps/details?id="
    assert rows(landed.review_posts(frame), "url_canon", "body") == sorted(
        [(base + "app#review=a", "bad"), (base + "app#review=b", "bad"), (base + "app#review=g", "undated"), (base + "other#review=a", "bad")], key=repr)
    late = landed.review_posts(frame, datetime(2026, 1, 5))
    assert rows(late, "url_canon") == [(base + "app#review=a",), (base + "other#review=a",)]


def test_documents_and_app_ids(spark, rows, tmp_path):
    (tmp_path / "apps.json").write_text('{"app_ids": ["com.a", " ", "com.b"]}')
    assert rows(landed.app_ids(spark, str(tmp_path / "apps.json"))) == [("com.a",), ("com.b",)]
    (tmp_path / "none.json").write_text('{"app_ids": []}')
    with pytest.raises(landed.LandedInputError):
        landed.app_ids(spark, str(tmp_path / "none.json"))
    (tmp_path / "pains.json").write_text('[{"post_url":"u","pains":[{"body":"b","audience":"a","quote":"q"}]},{"post_url":"v","pains":[]}]')
    assert rows(landed.expected_pains(spark, str(tmp_path / "pains.json")), "post_url", "quote") == [("u", "q"), ("v", None)]
    (tmp_path / "posts.json").write_text('[{"url":"u","title":"t","text":"x","kind":"demand","source":"s"}]')
    assert rows(landed.labelled_posts(spark, str(tmp_path / "posts.json"))) == [("u", "t", "x", "demand", "s")]


def land(root, source, name, *lines):
    folder = root / f"source_name={source}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines), encoding="utf-8")


def landed_line(url, text="b", **more):
    return json.dumps({"url": url, "title": "t", "text": text, "kind": "demand"} | more)


def test_collect_isolates_sources_and_reruns_empty(spark, rows, tmp_path):
    enabled = spark.createDataFrame([("1", "good"), ("2", "broken"), ("3", "unknown")], "id string, name string")
    land(tmp_path, "good", "a.json", *[landed_line(f"https://g.example/{i}") for i in (1, 2, 1)])
    land(tmp_path, "broken", "a.json", *[landed_line(f"https://b.example/{i}") for i in range(50)], '{"url": "https://b.exa')
    land(tmp_path, "disabled", "a.json", landed_line("https://d.example/1"), "{")
    posts, warnings = landed.gather(spark, str(tmp_path), enabled)
    assert rows(warnings) == [("broken", 1, "a line is no post"), ("unknown", 0, "nothing landed")]
    stored = spark.createDataFrame([], schemas.RAW_POST)
    first = stages.collect(posts, stored, at("2026-01-01"), warnings)
    assert rows(first.counters) == [(2, 1, 2)]
    found = [("https://g.example/1", "1", "new"), ("https://g.example/2", "1", "new")]
    assert rows(first.posts, "url_canon", "source_id", "fetch_status") == found
    second = stages.collect(posts, first.posts, at("2026-01-02"))
    assert rows(second.counters) == [(0, 3, 0)] and second.posts.isEmpty()


def test_extract_stage(spark, rows):
    post = spark.createDataFrame(
        [("p1", "it is slow", None, datetime(2026, 1, 1)), ("p2", "fine", "fetched", datetime(2026, 1, 2)), ("p3", "x", "failed", datetime(2026, 1, 3)),
         ("p4", "has a pain", "new", datetime(2026, 1, 4)), ("p5", "no answer", "new", datetime(2026, 1, 5))],
        "id string, body string, fetch_status string, created_at timestamp")
    pain = spark.createDataFrame([("p4",)], "raw_post_id string")
    pending = stages.pending_posts(post, pain)
    assert rows(pending, "id") == [("p1",), ("p2",), ("p5",)]
    assert rows(stages.pending_posts(post, pain, limit=1), "id") == [("p1",)]
    good = json.dumps({"pains": [{"body": "b", "audience": "a", "quote": "slow"}, {"body": "b", "audience": "a", "quote": "fast"}]})
    answers = spark.createDataFrame(
        [("p1", good, 10, 5, "m", False), ("p2", "??", 10, 5, "m", False), ("p5", None, 0, 0, "m", True)],
        "post_id string, answer string, prompt_tokens bigint, completion_tokens bigint, model string, call_failed boolean")
    prices = spark.createDataFrame([("m",)], "model string").withColumn("price_per_mtok", F.lit("2").cast("decimal(12,4)"))
    out = stages.extract(pending, answers, prices, "v1", at("2026-01-09"))
    c = out.counters.first()
    assert (c["processed"], c["extracted"], c["failed"], c["llm_errors"], c["hallucinated"], c["cost_micro"]) == (3, 1, 1, 1, 1, 30)
    assert rows(out.pains, "raw_post_id", "quote") == [("p1", "slow")]
    assert rows(out.statuses) == [("p1", "extracted"), ("p2", "failed")]
    assert rows(out.rejects, "raw_post_id", "reason") == [("p1", "hallucinated")]
    assert out.pains.select("id").first() == stages.extract(pending, answers, prices, "v1", at("2026-01-10")).pains.select("id").first()


def test_cluster_stage(spark, rows):
    post = spark.createDataFrame([("p1", "demand"), ("p2", "complaint"), ("p3", "demand"), ("p4", "discussion")], "id string, kind string")
    pain = spark.createDataFrame(
        [("a", "p2", [1.0, 0.0], datetime(2026, 1, 1)), ("b", "p1", [0.99, 0.05], datetime(2026, 1, 2)), ("c", "p3", [0.0, 1.0], datetime(2026, 1, 1)),
         ("d", "p4", None, datetime(2026, 1, 1))],
        "id string, raw_post_id string, embedding array<float>, created_at timestamp")
    out = stages.cluster(pain, post, at("2026-01-09"))
    assert rows(out.assignment, "id", "cluster_id") == [("a", "a"), ("b", "a"), ("c", "c")]
    assert rows(out.clusters, "id", "title", "size", "kind_mix") == sorted(
        [("a", "cluster complaint", 2, {"demand": 1, "complaint": 1}), ("c", "cluster demand", 1, {"demand": 1})], key=repr)
    assert rows(out.counters) == [(3, 2, 1, 1, 1)]


def test_score_and_validate_stages(spark, seed, rows):
    answers = spark.createDataFrame(
        [("k6", json.dumps({"score": 55, "rationale_md": "r", "quotes": ["body k6"]})), ("k1", "{}")], "cluster_id string, answer string")
    todo = stages.unscored_clusters(seed["cluster"], seed["score"])
    scored = stages.score(todo, answers, seed["members"], at("2026-01-09"))
    assert rows(scored.scores.withColumn("t", F.col("total").cast("string")), "cluster_id", "t") == [("k6", "5.50")]
    assert rows(scored.counters) == [(1, 1, 0, 0)]

    checks = spark.createDataFrame(
        [("x", "k1", "old", 5, datetime(2026, 1, 3)), ("y", "k2", "old", 5, datetime(2026, 1, 2, 23)), ("z", "k3", "fresh", 5, datetime(2026, 1, 9))],
        schemas.PHRASE_DEMAND)
    now = at("2026-01-10")
    stale = stages.stale_clusters(seed["cluster"], checks, now)
    assert rows(stale, "id") == [("k2",), ("k4",), ("k5",), ("k6",)]  # exactly seven days old is fresh
    phrases = spark.createDataFrame(
        [("k2", '{"phrases": ["old", "b", "c"]}'), ("k6", '{"phrases": ["a"]}'), ("k5", '{"phrases": ["d", "e", "f"]}')], "cluster_id string, answer string")
    known = spark.createDataFrame([("old", 100), ("b", 1), ("d", 99), ("e", 0)], "phrase string, frequency bigint")
    out = stages.validate(stale, phrases, known, seed["score"], checks, now)
    assert out.counters.first().asDict() == {
        "clusters": 3, "phrases": 6, "validated": 4, "rejected": 1, "api_errors": 2, "demand_confirmed": 1, "rationale_updated": 1}
    assert rows(out.checks.filter("cluster_id = 'k2'"), "phrase", "frequency") == [("b", 1), ("old", 100)]
    noted = {r["cluster_id"]: r["rationale_md"] for r in out.scores.collect()}
    assert noted["k2"] == "why" + stages.DEMAND_NOTE and noted["k1"] == "why"
    again = stages.validate(stale, phrases, known, out.scores, out.checks, now)
    assert again.counters.first()["rationale_updated"] == 0
    assert {r["cluster_id"]: r["rationale_md"] for r in again.scores.collect()} == noted


def test_stage_event_and_status(spark, rows):
    counters = spark.createDataFrame([(2, 1)], "collected bigint, skipped bigint")
    made = ledger.stage_event(counters, "r9", at("2026-01-01"), "collect")
    assert made.first()["stats_delta"] == {"collected": 2, "skipped": 1}
    assert ledger.fold_runs(made).first()["stages"] == {"collect": "done"}
    status = reports.catalog_status(spark, ["nowhere_at_all"])
    assert rows(status) == [("nowhere_at_all", None)]


def test_tables(spark, rows):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    first = tables.publish(one, "snap_demo", key="k", buckets=2)
    assert rows(spark.table("snap_demo")) == [("a", 1), ("b", 2)]
    second = tables.publish(spark.table("snap_demo").filter("v > 1"), "snap_demo", key="k", buckets=2)
    assert first != second and rows(spark.table("snap_demo")) == [("b", 2)]
    for _ in range(2):
        tables.append_new(one, "log_demo", "k", buckets=2)
    assert rows(spark.table("log_demo")) == [("a", 1), ("b", 2)]


def test_collect_stream(spark, rows, tmp_path):
    source, ck = tmp_path / "in", tmp_path / "ck"
    source.mkdir()
    schema = "url string, body string, published_at timestamp"

    def land(name, *posts):
        (source / name).write_text("\n".join(json.dumps({"url": u, "body": b, "published_at": t}) for u, b, t in posts))

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        jobs.collect_stream(stream, "stream_posts", str(ck), buckets=2).trigger(availableNow=True).start().awaitTermination()

    land("1.json", ("https://a/x", "copy", "2026-01-01T01:00:00Z"), ("https://a/x/?utm_source=1", "first", "2026-01-01T00:00:00Z"), ("rel", "bad", "2026-01-01T00:00:00Z"))
    run()
    land("2.json", ("https://a/x#", "late copy", "2026-03-01T00:00:00Z"), ("https://a/y", "new", "2026-03-01T00:00:00Z"))
    run()
    run()
    assert rows(spark.table("stream_posts"), "url_canon", "body") == [("https://a/x", "first"), ("https://a/y", "new")]


def test_ledger_and_health_streams(spark, rows, tmp_path):
    folder = str(tmp_path / "events")
    events(spark).write.parquet(folder)
    stream = spark.readStream.schema(events(spark).schema).parquet(folder)
    query = jobs.ledger_stream(stream).writeStream.outputMode("update").format("memory").queryName("ledger_mem").start()
    query.processAllAvailable()
    query.stop()
    assert ("r1", "collect", "done") in rows(spark.table("ledger_mem"), "run_id", "stage", "status")

    health = jobs.windowed_health(stream, "ts", "run_id", F.col("status") == "error")
    query = health.writeStream.outputMode("complete").format("memory").queryName("health_mem").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("health_mem"), "source", "total_count", "failed_count") == [("r1", 4, 1), ("r2", 1, 0)]


def test_repeated_keys_in_one_batch(spark, rows):
    stored = spark.createDataFrame([("p", 1, "a")], "name string, version int, body string")
    shipped = spark.createDataFrame(
        [("p", 1, "other"), ("q", 2, "second"), ("q", 2, "first"), ("q", 2, "first"), ("r", 1, "x")], "name string, version int, body string")
    assert rows(versions.register(stored, shipped)) == [("q", 2, "first"), ("r", 1, "x")]
    assert rows(versions.seed(stored, shipped)) == [("q", 2, "first"), ("r", 1, "x")]
    ordered = shipped.withColumn("at", F.when(F.col("body") == "second", 1).otherwise(2))
    assert rows(versions.register(stored.withColumn("at", F.lit(0)), ordered, ["at"]), "name", "body") == [("q", "second"), ("r", "x")]

    known = spark.createDataFrame([("one", "fake", "", "m", "k")], "name string, kind string, base_url string, model string, api_key string")
    new = spark.createDataFrame([(" two ", "fake", "", "b", "k"), ("two", "fake", "", "a", "k"), ("one", "fake", "", "z", "k")], known.schema)
    assert rows(providers.add(known, new), "name", "model") == [("two", "a")]

    table = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id bigint, label string, n int")
    changes = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 0)], "id bigint, label string, seq int")
    assert rows(merge.update_keyed(table, changes, "id", order=["seq"])) == [(1, "a", 0), (2, "y", 0)]
    assert rows(merge.update_keyed(table, changes.drop("seq"), "id")) == [(1, "b", 0), (2, "y", 0)]
    gaps = spark.createDataFrame([(1, None), (2, 5)], "id bigint, v int")
    values = spark.createDataFrame([(1, 8), (1, 7), (2, 1)], "id bigint, v int")
    assert rows(merge.fill_missing(gaps, values, "id", "v")) == [(1, 7), (2, 5)]
    named = spark.createDataFrame([("i2", "n"), ("i1", "n")], "id string, name string")
    assert rows(merge.get_or_create(named, spark.createDataFrame([("n",)], "name string"), "name")) == [("i1", "n")]


def test_snapshots_expire_and_appends_compact(spark, rows):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(30)], "k bigint, v string")
    for n in range(4):
        tables.publish(frame.withColumn("n", F.lit(n)), "snap_t", "k", 2)
    assert {r["n"] for r in spark.table("snap_t").collect()} == {3}
    assert len([t for t in spark.catalog.listTables(pattern="snap_t__*")]) == 2
    tables.append_new(frame.filter("k < 20"), "app_t", "k", 4)
    tables.append_new(frame.filter("k >= 10"), "app_t", "k")
    tables.append_new(frame, "app_t", "k")
    assert rows(spark.table("app_t")) == rows(frame)
    tables.compact(spark, "app_t", "k", 3)
    assert rows(spark.table("app_t")) == rows(frame)
    assert len(spark.table("app_t").inputFiles()) <= 3
    tables.append_new(frame.withColumn("k", F.col("k") + 1), "app_t", "k")
    assert spark.table("app_t").count() == 31


def test_gather_meets_a_break_anywhere(spark, rows, tmp_path):
    item = "<item><title>A &amp;amp; B {0}</title><link> https://f.example/{0} </link><pubDate>Mon, 05 Jan 2026 10:00:00 +0300</pubDate><description>d{0}</description></item>"
    feed = "<rss version='2.0'><channel><title>x</title>" + "".join(item.format(i) for i in range(3)) + "<item><title>no link</title></item></channel></rss>"
    land(tmp_path, "feed", "1.xml", feed)
    land(tmp_path, "torn", "1.xml", feed)
    land(tmp_path, "torn", "2.xml", feed[: len(feed) // 2])
    land(tmp_path, "late", "1.json", *[landed_line(f"https://l.example/{i}") for i in range(500)], "", "not json", landed_line("https://l.example/x"))
    land(tmp_path, "two", "1.json", landed_line("https://t.example/1", kind=None), landed_line(None), landed_line("https://t.example/2", published_at="2026-01-01T00:00:00Z"))
    land(tmp_path, "two", "empty.xml", "<rss><channel/></rss>")
    land(tmp_path, "two", "notes.md", "{ never read")
    names = ["feed", "torn", "late", "two", "absent"]
    enabled = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, name string")
    posts, warnings = landed.gather(spark, str(tmp_path), enabled)
    assert rows(warnings) == [("absent", 0, "nothing landed"), ("late", 1, "a line is no post"), ("torn", 1, "the feed breaks off")]
    assert rows(posts, "source_id", "url", "title", "body", "kind") == sorted(
        [("0", f"https://f.example/{i}", f"A & B {i}", f"d{i}", "discussion") for i in range(3)]
        + [("3", "https://t.example/1", "t", "b", "discussion"), ("3", "https://t.example/2", "t", "b", "demand"), ("3", None, "t", "b", "demand")],
        key=repr,
    )
    assert posts.filter("source_id = '0'").select("published_at").distinct().first()[0] == datetime(2026, 1, 5, 7)


def test_line_delta_takes_tasks_by_bytes(spark, rows, monkeypatch):
    stored = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "b\nc"), ("q", 1, "a")], "name string, version int, body string")
    monkeypatch.setattr(versions, "DELTA_BYTES", 1)
    found = versions.line_delta(stored)
    assert "version#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 8), REPARTITION_BY_NUM" in plan
    assert rows(found) == [("p", 2, 1, ["c"], ["a"], 0)]


def test_gathered_posts_are_not_dealt_by_source(spark, tmp_path):
    (tmp_path / "source_name=one").mkdir()
    (tmp_path / "source_name=one" / "a.json").write_text('{"url": "https://p.example/1", "text": "t"}')
    enabled = spark.createDataFrame([("id-one", "one")], "id string, name string")
    for limit in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(limit, -1)
    try:
        plan = landed.gather(spark, str(tmp_path), enabled).posts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_gather_runs_as_many_jobs_for_many_sources(spark, tmp_path):
    def jobs(n):
        root = tmp_path / f"of{n}"
        for i in range(n):
            land(root, f"s{i}", "a.json", landed_line(f"https://g.example/{i}"), *(["{"] if i % 3 == 0 else []))
        enabled = spark.createDataFrame([(str(i), f"s{i}") for i in range(n)], "id string, name string")
        spark.sparkContext.setJobGroup(f"gather{n}", "gather")
        found = landed.gather(spark, str(root), enabled)
        assert found.warnings.count() == -(-n // 3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"gather{n}"))

    # Adaptive execution may split a job.
    assert jobs(12) <= jobs(3) + 2


def rising(places):
    """Longest rising run by trying every start."""
    best = [1] * len(places)
    for i in range(len(places)):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
    return max(best, default=0)


def test_line_delta_counts_repeats_and_moves(spark, rows):
    rng = random.Random(4)
    bodies = [["a", "b", "c", "d"], ["d", "a", "b", "c"], ["d", "a", "a", "", "c"], [""], ["x", "x", "x"], ["x", "y", "x"]]
    bodies += [[rng.choice("abcdefghijklmn") for _ in range(rng.randrange(1, 14))] for _ in range(25)]
    stored = spark.createDataFrame([("p", i + 1, "\n".join(b)) for i, b in enumerate(bodies)] + [("q", 1, "only")], "name string, version int, body string")
    want = []
    for i, (old, new) in enumerate(zip(bodies, bodies[1:], strict=False)):
        more = Counter(new)
        more.subtract(Counter(old))
        once = [x for x in new if new.count(x) == 1 == old.count(x)]
        added, dropped = ([x for x in sorted(more) for _ in range(sign * more[x])] for sign in (1, -1))
        want.append(("p", i + 2, i + 1, added, dropped, len(once) - rising([old.index(x) for x in once])))
    assert rows(versions.line_delta(stored)) == sorted(want, key=repr)
    assert {w[5] for w in want} > {0, 1}


def test_snapshots_commit_once_and_can_be_restored(spark, tmp_path):
    root = str(tmp_path / "state")

    def numbers(n):
        return spark.range(n)

    assert snapshots.latest(spark, root) == 0 and snapshots.versions(spark, root) == []
    with pytest.raises(LookupError):
        snapshots.read(spark, root)
    assert snapshots.commit(numbers(3), root, 0) == 1
    assert snapshots.commit(numbers(5), root, 1) == 2
    held = snapshots.read(spark, root, 1)
    with pytest.raises(snapshots.CommitConflict):
        snapshots.commit(numbers(9), root, 1)
    # Two writers that both saw version 2 before either committed.
    with pytest.raises(snapshots.CommitConflict):
        snapshots._put(spark, root, 2, "data/late")
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2 and not list((tmp_path / "state" / "draft").glob("[!.]*"))
    assert held.count() == 3 and snapshots.read(spark, root).count() == 5
    assert snapshots.roll_back(spark, root, 1, 2) == 3
    assert snapshots.read(spark, root).count() == 3
    # Versions 1 and 3 share their files: only those of version 2 go.
    assert snapshots.expire(spark, root, keep=1) == 1
    assert snapshots.versions(spark, root) == [3] and snapshots.read(spark, root).count() == 3
    with pytest.raises(LookupError):
        snapshots.roll_back(spark, root, 2, 3)


def test_stored_ledger_counts_a_replayed_batch_once(spark, rows, tmp_path):
    day = datetime(2026, 1, 1)
    events = spark.createDataFrame(
        [(i, f"r{i % 3}", day.replace(minute=i), None if i % 7 == 0 else "extract", "finished" if i % 7 == 0 else ["running", "done"][i % 2], {"pains": i, "failed": 1}, Decimal(i), "v" if i % 2 else None)
         for i in range(40)], schemas.RUN_EVENT)
    path = str(tmp_path / "ledger")
    for epoch, batch in ((0, events.filter("event_id >= 25")), (1, events.filter("event_id < 25")), (1, events.filter("event_id < 25"))):
        jobs.store_partials(batch, path, epoch)
    assert rows(jobs.stored_ledger(spark, path)) == rows(ledger.fold_runs(events))


def test_time_ordered_ids(spark):
    times = [datetime(1960, 1, 1), datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 0, 1000), datetime(2286, 1, 1), None]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t timestamp, k int")
    ids = [r[0] for r in frame.orderBy("k").select(schemas.time_ordered_id(F.col("t"), F.col("k"))).collect()]
    assert ids[1:4] == sorted(ids[1:4]) and len(set(ids)) == 5 and {len(i) for i in ids} == {32}
    assert ids[0][:12] == ids[4][:12] == "0" * 12
    again = [r[0] for r in frame.orderBy("k").select(schemas.time_ordered_id(F.col("t"), F.col("k"))).collect()]
    assert again == ids
