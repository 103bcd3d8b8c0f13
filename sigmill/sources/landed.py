"""Readers over landed files: labelled posts, feeds, store reviews, app lists and web pages.

Every reader takes an explicit schema. Posts come out with one common set of columns
(``POST_COLUMNS``) plus ``seq``, a deterministic reading order for keep-first dedup.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill import schemas
from sigmill.functions import text as tx
from sigmill.functions import urls
from sigmill.functions.expr import with_once
from sigmill.operators.dedup import keep_first
from sigmill.session import cut

POST_COLUMNS = ("url_canon", "url", "title", "body", "kind", "published_at", "suspect_short")

# Fixed value: reviews with at most this many stars are complaints.
MAX_COMPLAINT_STARS = 3


class LandedInputError(ValueError):
    """A landed input that must not be empty or malformed is."""


def _reading_order() -> Column:
    return F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))


def labelled_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of labelled posts."""
    return spark.read.schema(schemas.LABELLED_POST).option("multiLine", True).json(path)


def expected_pains(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of expected pains, one row per pain; a post without pains keeps one NULL row."""
    raw = spark.read.schema(schemas.EXPECTED_PAINS).option("multiLine", True).json(path)
    return raw.select("post_url", F.posexplode_outer("pains").alias("pos", "pain")).select(
        "post_url", "pos", "pain.body", "pain.audience", "pain.quote"
    )


def app_ids(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank application ids; an empty list is an error."""
    raw = spark.read.schema(schemas.APP_LIST).option("multiLine", True).json(path)
    ids = raw.select(F.explode("app_ids").alias("app_id")).filter(tx.has_text("app_id"))
    if ids.isEmpty():
        raise LandedInputError(f"no application ids in {path}")
    return ids


def feed_items(
    spark: SparkSession, path: str, *, require_title: bool, double_escaped: bool = False, strict: bool = False
) -> DataFrame:
    """Items of RSS files: ``seq, title, link, published_at``.

    ``strict`` raises on a malformed file; otherwise its broken items are dropped (a whole item
    that precedes the break is kept). ``double_escaped`` decodes entities once more.
    """
    raw = (
        spark.read.format("xml")
        .schema(schemas.FEED_ITEM)
        .option("rowTag", "item")
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .load(path)
    )

    def field(name: str) -> Column:
        value = tx.strip(name)
        return tx.decode_entities(value) if double_escaped else value

    items = raw.select(
        _reading_order().alias("seq"),
        F.coalesce(field("title"), F.lit("")).alias("title"),
        field("link").alias("link"),
        tx.rfc822_utc("pubDate").alias("published_at"),
    ).filter(tx.has_text("link"))
    return items.filter(tx.has_text("title")) if require_title else items


def since(published_at: Column, cutoff: datetime | None, inclusive: bool = True) -> Column:
    """Incremental cutoff. Undated rows pass only when there is no cutoff."""
    if cutoff is None:
        return F.lit(True)
    bound = F.lit(cutoff)
    return published_at >= bound if inclusive else published_at > bound


def feed_posts(
    items: DataFrame,
    pages: DataFrame,
    kind: str,
    cutoff: datetime | None = None,
    inclusive: bool = True,
    closed: bool = False,
) -> DataFrame:
    """Feed items joined with the landed pages they link to (``url``, ``html``).

    Items without a landed page, a usable link or any text are dropped. One landed page may be
    linked by many items; pages are keyed by canonical URL. ``closed`` is that of ``main_text``.
    """
    recent = with_once(
        items.filter(since(F.col("published_at"), cutoff, inclusive)), "url_canon", urls.canonical_url("link")
    )
    texts = page_texts(pages, closed).select("url_canon", "body", "suspect_short")
    return (
        recent.filter("url_canon IS NOT NULL")
        .join(texts, "url_canon")
        .filter("body <> ''")
        .select(
            "seq", "url_canon", F.col("link").alias("url"), "title", "body",
            F.lit(kind).alias("kind"), "published_at", "suspect_short",
        )
    )


def page_texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Landed pages as text, one row per canonical URL (the first by URL wins)."""
    # The page is picked before its text is extracted, so copies cost no extraction.
    keyed = with_once(pages.select("url", "html"), "url_canon", urls.canonical_url("url"))
    picked = keep_first(keyed.filter("url_canon IS NOT NULL"), ["url_canon"], ["url"])
    return with_once(picked, "body", tx.main_text("html", closed)).drop("html").withColumn("suspect_short", tx.is_short("body"))


def reviews(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schemas.REVIEW)
    return (reader.parquet(path) if fmt == "parquet" else reader.json(path)).withColumn("seq", _reading_order())


def is_complaint(stars: Column, content: Column, review_id: Column) -> Column:
    """One to three whole stars, some text, and an id."""
    whole = F.when(stars.cast("string").rlike(r"^-?\d{1,9}$"), stars.cast("string").cast("int"))
    return whole.between(1, MAX_COMPLAINT_STARS) & tx.has_text(content) & (review_id != "")


def review_posts(landed: DataFrame, cutoff: datetime | None = None) -> DataFrame:
    """Complaint reviews as posts; a review repeated across pages is kept once, first wins."""
    kept = landed.filter(
        is_complaint(F.col("score"), F.col("content"), F.col("reviewId"))
        & since(F.col("at"), cutoff, inclusive=True)
    )
    addressed = kept.withColumn("url", urls.review_url(F.col("app_id"), F.col("reviewId")))
    posts = with_once(addressed, "url_canon", urls.canonical_url("url")).select(
        "seq",
        "url_canon",
        "url",
        F.coalesce("userName", F.lit("")).alias("title"),
        F.col("content").alias("body"),
        F.lit("complaint").alias("kind"),
        F.col("at").alias("published_at"),
        tx.is_short("content").alias("suspect_short"),
    )
    return keep_first(posts, ["url_canon"], ["seq"])


def with_source_ids(posts: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts tagged with a source name get the source's id: ``(posts, warnings)``.

    Rows of a name nobody registered are left out and counted, one warning row per name.
    """
    ids = source.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    joined = posts.join(ids, "source_name", "left")
    unknown = joined.filter("source_id IS NULL").groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"))
    return joined.filter("source_id IS NOT NULL"), unknown


#: Posts as landed, one a line; names of files of such lines, and of feeds.
LANDED_POST = "url string, title string, text string, kind string, published_at timestamp"
LINES, FEEDS = "*.{json,jsonl,json.gz,jsonl.gz}", "*.{xml,rss}"


class Gathered(NamedTuple):
    posts: DataFrame
    warnings: DataFrame


def _landed(spark: SparkSession, root: str, names: str, whole: bool) -> DataFrame:
    """Lines or whole files under ``root/source_name=.../``, each file read once."""
    read = spark.read.schema("value string, source_name string").option("wholetext", whole).option("pathGlobFilter", names)
    return read.text(root).select("source_name", _reading_order().alias("seq"), "value")


def _line_posts(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("value", f"{LANDED_POST}, broken string", {"columnNameOfCorruptRecord": "broken"})
    rows = lines.filter(tx.has_text("value")).withColumn("post", parsed)
    torn = F.col("post").isNull() | F.col("post.broken").isNotNull()
    post = F.struct(*[F.col(f"post.{c}").alias(c) for c in ("url", "title", "text", "kind", "published_at")])
    return rows.select("source_name", "seq", F.when(torn, F.lit("a line is no post")).alias("error"), F.when(~torn, post).alias("post"))


def _feed_posts(files: DataFrame) -> DataFrame:
    item = f"array<struct<{', '.join(f.replace(' ', ':') for f in schemas.FEED_ITEM.split(', '))}>>"
    # The items stand in the channel; what holds the channel may be left out.
    schema = f"channel struct<item:{item}>, item {item}, broken string"
    rows = files.withColumn("feed", F.from_xml("value", schema, {"columnNameOfCorruptRecord": "broken"}))
    torn = F.col("feed").isNull() | F.col("feed.broken").isNotNull()
    items = F.when(~torn, F.coalesce("feed.channel.item", "feed.item"))
    each = rows.select("source_name", "seq", F.when(torn, F.lit("the feed breaks off")).alias("error"), F.posexplode_outer(items).alias("place", "i"))
    post = F.struct(
        tx.strip("i.link").alias("url"), tx.decode_entities(F.coalesce(tx.strip("i.title"), F.lit(""))).alias("title"),
        F.coalesce(tx.strip("i.description"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("kind"),
        tx.rfc822_utc("i.pubDate").alias("published_at"),
    )
    # Items are read in their order within the file.
    seq = F.struct("seq.file", (F.col("seq.at") * F.lit(1 << 20) + F.coalesce("place", F.lit(0))).alias("at"))
    return each.select("source_name", seq.alias("seq"), "error", F.when(F.col("i").isNotNull() & tx.has_text("i.link"), post).alias("post"))


def gather(
    spark: SparkSession, root: str, enabled: DataFrame, kind: str = "discussion", lines: str = LINES, feeds: str = FEEDS
) -> Gathered:
    """The landed posts of every enabled source (``id, name``), and one warning for each source that fails.

    A source's files lie in ``root/source_name=<name>/``: posts as JSON, one a line, where the file's name
    matches ``lines``, and feeds where it matches ``feeds``. One job reads all files of all sources, each once, into rows: a post, or an error where a
    line or a feed can't be parsed. An error anywhere in a source's files, however late, keeps back the whole
    source: it contributes no posts and one row ``source_name, files, reason`` of ``warnings``; the others
    deliver. So does a source of which nothing landed. Files of sources that aren't enabled are ignored.

    ``kind`` is that of posts that don't say theirs. Posts without an address are kept back by ``url_canon``.
    """
    rows = _line_posts(_landed(spark, root, lines, whole=False)).unionByName(_feed_posts(_landed(spark, root, feeds, whole=True)))
    rows = cut(rows, "gathered")
    wanted = enabled.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    failed = rows.filter("error IS NOT NULL").groupBy("source_name").agg(
        F.count_distinct("seq.file").alias("files"), F.min("error").alias("reason")
    )
    found = rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        # A row for each source: it goes to the posts, which are never dealt by source.
        right = F.broadcast(right.withColumnRenamed("source_name", "_name"))
        return left.join(right, left["source_name"].eqNullSafe(right["_name"]), how).drop("_name")

    missing = joined(wanted, found, "left_anti").select("source_name", F.lit(0).cast("bigint").alias("files"), F.lit("nothing landed").alias("reason"))
    warnings = joined(failed, wanted.select("source_name"), "left_semi").unionByName(missing)
    kept = joined(joined(rows.filter("post IS NOT NULL"), failed.select("source_name"), "left_anti"), wanted, "inner")
    posts = with_once(kept, "url_canon", urls.canonical_url("post.url")).select(
        "source_id", "source_name", "seq", "url_canon", F.col("post.url").alias("url"), F.coalesce("post.title", F.lit("")).alias("title"),
        F.col("post.text").alias("body"), F.coalesce("post.kind", F.lit(kind)).alias("kind"), "post.published_at",
        tx.is_short("post.text").alias("suspect_short"),
    )
    return Gathered(posts, warnings)
