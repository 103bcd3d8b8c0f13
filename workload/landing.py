"""Queries that go through landed files, sinks and streams: rows of the tables are written as files first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions.text import strip
from sigmill.plans import snapshots, tables
from sigmill.session import cut, scratch_dir
from sigmill.sources import landed
from sigmill.streaming import jobs
from workload.base import Tables, query, stamp

# Rows per landed file, about.
PER_FILE = 100


def _as_arrays(t: Tables, rows: DataFrame, column: str, purpose: str) -> str:
    """One JSON array per file, of the given structs; the number of files follows the rows."""
    path = scratch_dir(t.spark, purpose)
    files = rows.count() // PER_FILE + 1
    bucket = F.pmod(F.xxhash64(column), F.lit(files))
    arrays = rows.groupBy(bucket.alias("file")).agg(F.to_json(F.collect_list(column)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _xml(rows: DataFrame, path: str) -> None:
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


@query(
    "landed_labelled_posts",
    "SELECT 'https://posts.example/' || doc_id AS url, source, md5(text) AS text_md5, length(text) AS n FROM documents",
)
def landed_labelled_posts(t: Tables) -> DataFrame:
    post = F.struct(
        F.concat(F.lit("https://posts.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("t").alias("title"), "text",
        F.lit("demand").alias("kind"), "source",
    ).alias("post")
    path = _as_arrays(t, t.documents.select(post), "post", "labelled")
    found = landed.labelled_posts(t.spark, path)
    return found.select("url", "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query("landed_app_ids", "SELECT c_name AS app_id, count(*) AS n FROM customer GROUP BY c_name")
def landed_app_ids(t: Tables) -> DataFrame:
    # Lists of about a hundred names.
    file = F.pmod(F.xxhash64("c_custkey"), F.lit(t.customer.count() // PER_FILE + 1))
    lists = t.customer.groupBy(file.alias("file")).agg(
        F.to_json(F.struct(F.concat(F.collect_list("c_name"), F.array(F.lit(" "))).alias("app_ids"))).alias("value")
    )
    path = scratch_dir(t.spark, "apps")
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return landed.app_ids(t.spark, path).groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))


_FEED = """
    SELECT doc_id, 'https://feed.example/' || doc_id AS link, 'title ' || doc_id || ' & <more>' AS title,
           strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id) - to_hours(CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END),
                    '%Y-%m-%d %H:%M:%S') AS published_at
    FROM documents"""


def _feed(t: Tables) -> DataFrame:
    when = t.minutes_after_start("doc_id")
    zone = F.when(F.col("doc_id") % 2 == 0, " +0300").otherwise(" GMT")
    key = F.col("doc_id").cast("string")
    return t.documents.select(
        F.concat(F.lit("title "), key, F.lit(" & <more>")).alias("title"),
        F.concat(F.lit(" https://feed.example/"), key).alias("link"),
        F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), zone).alias("pubDate"),
        F.col("text").alias("description"),
    )


@query("landed_feed_items", f"SELECT link, title, published_at FROM ({_FEED})")
def landed_feed_items(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "feed")
    _xml(_feed(t), path)
    items = landed.feed_items(t.spark, path, require_title=True)
    return items.select("link", "title", stamp("published_at"))


@query(
    "landed_reviews",
    """SELECT 'https://play.google.com/store/apps/details?id=app' || event_id % 5 || '#review=r' || event_id AS url_canon,
              strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published_at
       FROM events WHERE event_id % 6 BETWEEN 1 AND 3 AND trim(props) <> ''""",
)
def landed_reviews(t: Tables) -> DataFrame:
    key = F.col("event_id").cast("string")
    rows = t.events.select(
        F.concat(F.lit("app"), (F.col("event_id") % 5).cast("string")).alias("app_id"), F.concat(F.lit("r"), key).alias("reviewId"),
        F.lit("u").alias("userName"), F.col("props").alias("content"), (F.col("event_id") % 6).cast("string").alias("score"),
        F.lit(0).alias("thumbsUpCount"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"),
    )
    path = scratch_dir(t.spark, "reviews")
    # Every review lands twice, as it does where pages overlap.
    rows.unionByName(rows).write.json(path)
    return landed.review_posts(landed.reviews(t.spark, path)).select("url_canon", stamp("published_at"))


def _torn(rows: DataFrame, path: str) -> None:
    """The rows as lines of one source, in the midst of which one line breaks off."""
    line = F.to_json(F.struct(F.concat(F.lit("https://t.example/"), F.col("doc_id").cast("string")).alias("url"), "text"))
    middle = F.col("doc_id") == rows.count() // 2
    rows.select(F.when(middle, F.substring(line, 1, 30)).otherwise(line).alias("value")).write.option("compression", "gzip").text(path)


def _summary(found: landed.Gathered) -> DataFrame:
    """Posts and characters of each source, beside how many sources failed and why."""
    failed = found.warnings.agg(F.count(F.lit(1)).alias("warnings"), F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons"))
    per_source = found.posts.groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("body")).alias("chars"))
    return per_source.withColumns({c: failed.select(c).scalar() for c in failed.columns})


@query(
    "gather_every_source",
    """SELECT source AS source_name, count(*) AS rows, sum(length(text)) AS chars,
              (SELECT count(*) FROM (VALUES ('torn lines'), ('torn feed'), ('nothing landed'))) AS warnings,
              'a line is no post, nothing landed, the feed breaks off' AS reasons FROM documents GROUP BY 1""",
)
def gather_every_source(t: Tables) -> DataFrame:
    """Every document lands with its source; beside them are two sources that break midway and one without files."""
    root = scratch_dir(t.spark, "landing")
    post = t.documents.select(F.concat(F.lit("https://p.example/"), F.col("doc_id").cast("string")).alias("url"), "text", F.col("source").alias("source_name"))
    post.write.partitionBy("source_name").json(root)
    feed = "<rss><channel>" + "<item><title>One</title><link>https://b.example/1</link></item>" * 50
    t.spark.createDataFrame([(feed + "<item><title>Two</title><link>https://b.exa",)], "value string").write.text(f"{root}/source_name=feed")
    _torn(t.documents, f"{root}/source_name=lines")
    names = t.documents.select(F.col("source").alias("name")).distinct()
    more = t.spark.createDataFrame([("feed",), ("lines",), ("unread",)], "name string")
    enabled = names.unionByName(more).select(F.concat(F.lit("id-"), F.coalesce("name", F.lit("none"))).alias("id"), "name")
    return _summary(landed.gather(t.spark, root, enabled, lines="*.{json,txt.gz}", feeds="*.txt"))


def _posts(t: Tables) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return t.documents.select(
        F.concat(F.lit("https://posts.example/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 40).cast("string"), F.lit("?utm_id="), key).alias("url"),
        strip("text").alias("body"), t.minutes_after_start("doc_id").alias("published_at"),
    )


_FIRST_POSTS = """
    SELECT url_canon, md5(arg_min(body, doc_id)) AS body_md5
    FROM (SELECT 'https://posts.example/' || source || '/' || doc_id % 40 AS url_canon, doc_id,
                 trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents) GROUP BY 1"""


@query("append_twice", _FIRST_POSTS)
def append_twice(t: Tables) -> DataFrame:
    """The same batch through the sink twice: the second time nothing is new."""
    name = f"posts_{uuid.uuid4().hex}"
    batch = jobs.first_posts(_posts(t))
    for _ in range(2):
        tables.append_new(batch, name, "url_canon")
    return t.spark.table(name).select("url_canon", F.md5("body").alias("body_md5"))


@query("collect_stream_table", _FIRST_POSTS)
def collect_stream_table(t: Tables) -> DataFrame:
    """Continuous collect over landed files: of each address the earliest copy is stored."""
    path, name = scratch_dir(t.spark, "stream"), f"stream_{uuid.uuid4().hex}"
    _posts(t).orderBy(F.desc("published_at")).write.json(f"{path}/in")
    schema = "url string, body string, published_at timestamp"
    stream = t.spark.readStream.schema(schema).json(f"{path}/in")
    jobs.collect_stream(stream, name, f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).select("url_canon", F.md5("body").alias("body_md5"))


@query(
    "published_snapshots",
    """SELECT 'first' AS reading, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT 'newest', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
       UNION ALL SELECT 'rolled back', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT 'conflicts', 1, 2 UNION ALL SELECT 'expired', 1, NULL""",
)
def published_snapshots(t: Tables) -> DataFrame:
    """Two snapshots, a writer that comes too late, the older version read and restored, and the other one dropped."""
    root, spark = scratch_dir(t.spark, "snapshots"), t.spark
    orders = t.orders.select("o_orderkey", "o_totalprice")
    third = orders.filter("o_orderkey % 3 = 0")
    first = snapshots.commit(third, root, 0)
    second = snapshots.commit(orders, root, first)
    conflicts = 0
    try:
        snapshots.commit(third, root, first)
    except snapshots.CommitConflict:
        conflicts += 1

    def reading(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).select(F.lit(name).alias("reading"), "rows", "keys")

    seen = cut(reading("first", snapshots.read(spark, root, first)).unionByName(reading("newest", snapshots.read(spark, root))), "readings")
    third_version = snapshots.roll_back(spark, root, first, second)
    expired = snapshots.expire(spark, root, keep=1)
    back = reading("rolled back", snapshots.read(spark, root, third_version))
    facts = spark.createDataFrame([("conflicts", conflicts, second), ("expired", expired, None)], "reading string, rows bigint, keys bigint")
    return seen.unionByName(back).unionByName(facts)
