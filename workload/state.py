"""State merges over orders, customers and the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions.text import keep_if_blank
from sigmill.operators import merge
from sigmill.plans import providers
from sigmill.sources import landed
from workload.base import Tables, query


@query(
    "upsert_insert_if_absent",
    """SELECT o_orderkey, o_totalprice FROM (
         SELECT o_custkey AS key, o_orderkey, o_totalprice,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       WHERE rn = 1 AND key NOT IN (SELECT c_custkey * 2 FROM customer)""",
)
def insert_if_absent(t: Tables) -> DataFrame:
    stored = t.customer.select((F.col("c_custkey") * 2).alias("o_custkey"))
    offered = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    fresh, _ = merge.insert_if_absent(stored, offered, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return fresh.select("o_orderkey", "o_totalprice")


@query(
    "insert_counts",
    """SELECT count(DISTINCT o_custkey) AS inserted, (SELECT count(*) FROM orders) - count(DISTINCT o_custkey) AS skipped
       FROM orders WHERE o_custkey NOT IN (SELECT c_custkey * 2 FROM customer)""",
)
def insert_counts(t: Tables) -> DataFrame:
    stored = t.customer.select((F.col("c_custkey") * 2).alias("o_custkey"))
    offered = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return merge.insert_if_absent(stored, offered, ["o_custkey"], ["o_orderdate", "o_orderkey"])[1]


@query(
    "upsert_last_wins",
    """SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'order ' || n.o ELSE c.c_name END AS c_name,
              coalesce(n.price, c.c_acctbal) AS c_acctbal
       FROM (SELECT * REPLACE (c_custkey * 2 AS c_custkey) FROM customer) c
       FULL JOIN (SELECT o_custkey AS k, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o,
                         max_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1) n ON n.k = c.c_custkey""",
)
def upsert_last_wins(t: Tables) -> DataFrame:
    stored = t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name", "c_acctbal")
    changes = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey",
    )
    return merge.upsert_last_wins(stored, changes, ["c_custkey"], ["o_orderdate", "o_orderkey"], keep=("c_name",))


@query(
    "update_clear_label",
    """SELECT c.id, c.title, CASE WHEN c.id = 7 THEN NULL WHEN c.id = 4 THEN 'hidden' ELSE c.feedback END AS feedback
       FROM cluster_v c""",
    ("cluster_v",),
)
def update_clear_label(t: Tables) -> DataFrame:
    changes = t.spark.createDataFrame([(7, None), (4, "hidden"), (999, "hidden")], "id bigint, feedback string")
    return merge.update_keyed(t.cluster, changes, "id").select("id", "title", "feedback")


@query(
    "update_statuses",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 1 THEN 'extracted' ELSE 'failed' END AS fetch_status
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def update_statuses(t: Tables) -> DataFrame:
    stored = t.documents.select("doc_id", F.lit("new").alias("fetch_status"))
    changes = t.labels.select("doc_id", F.when(F.col("quality") == 1, "extracted").otherwise("failed").alias("fetch_status"))
    return merge.update_keyed(stored, changes, "doc_id", strict=True)


@query(
    "single_active",
    "SELECT s_suppkey, s_name, s_suppkey = 3 AS is_active FROM supplier ORDER BY is_active DESC, s_name",
)
def single_active(t: Tables) -> DataFrame:
    stored = t.supplier.select("s_suppkey", "s_name", (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    flipped = merge.set_single_active(stored, "s_name", "Supplier#000000003")
    return flipped.orderBy(F.desc("is_active"), "s_name")


@query("none_active", "SELECT count(*) FILTER (WHERE s_suppkey % 2 = 0 AND s_suppkey <> 4) AS active, count(*) AS n FROM supplier")
def none_active(t: Tables) -> DataFrame:
    # Many are active here, so that it shows which one is switched off.
    stored = t.supplier.select("s_name", (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    off = merge.set_inactive(stored, "s_name", "Supplier#000000004")
    return off.agg(F.count_if("is_active").alias("active"), F.count(F.lit(1)).alias("n"))


@query(
    "delete_keys",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def delete_keys(t: Tables) -> DataFrame:
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.delete_keys(t.customer.select("c_custkey", "c_name"), gone, "c_custkey")[0]


@query(
    "delete_hits",
    """SELECT n.k AS c_custkey, c.c_custkey IS NOT NULL AS deleted
       FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) n LEFT JOIN customer c ON c.c_custkey = n.k""",
)
def delete_hits(t: Tables) -> DataFrame:
    gone = t.orders.select((F.col("o_custkey") * 2).alias("c_custkey"))
    return merge.delete_keys(t.customer, gone, "c_custkey")[1]


@query(
    "fill_missing",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN coalesce(l.quality, -1) ELSE 7 END AS quality
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def fill_missing(t: Tables) -> DataFrame:
    stored = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, 7).alias("quality"))
    filled = merge.fill_missing(stored, t.labels.select("doc_id", "quality"), "doc_id", "quality")
    return filled.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(
    "get_or_create",
    """SELECT name, CASE WHEN enabled THEN id ELSE sha256('{"k0":"' || name || '"}') END AS id
       FROM (SELECT DISTINCT s.name, s.enabled, s.id FROM source_v s JOIN documents d ON d.source = s.name)""",
    ("source_v",),
)
def get_or_create(t: Tables) -> DataFrame:
    stored = t.source.filter("enabled").select("id", "name")
    return merge.get_or_create(stored, t.documents.select(F.col("source").alias("name")), "name")


@query(
    "merge_maps",
    """SELECT user_id, array_to_string(list_sort(list(k || '=' || n)), ',') AS stats FROM (
         SELECT user_id, k, CAST(sum(n) AS BIGINT) AS n FROM (
           SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL
           UNION ALL SELECT user_id, event_type, count(*) FROM events WHERE event_id % 3 = 0 GROUP BY ALL) GROUP BY ALL)
       GROUP BY user_id""",
)
def merge_maps(t: Tables) -> DataFrame:
    def counts(condition: str, name: str) -> DataFrame:
        per_kind = t.events.filter(condition).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return per_kind.groupBy("user_id").agg(
            F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(name)
        )

    both = counts("true", "a").join(counts("event_id % 3 = 0", "b"), "user_id", "full")
    empty = F.create_map().cast("map<string,bigint>")
    merged = merge.merge_maps(F.coalesce("a", empty), F.coalesce("b", empty))
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return both.select("user_id", F.array_join(F.array_sort(pairs), ",").alias("stats"))


@query(
    "keep_if_blank",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS secret FROM customer",
)
def keep_blank(t: Tables) -> DataFrame:
    new = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", keep_if_blank(new, F.col("c_name")).alias("secret"))


def _providers(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "fake").otherwise("openai_compat").alias("kind"),
        F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("https://m"), key.cast("string"))).alias("base_url"),
        F.concat(F.lit("m"), (key % 5).cast("string")).alias("model"),
        F.substr("s_name", F.lit(1), (key % 25).cast("int")).alias("api_key"),
        (key == 4).alias("is_active"),
        (key * 3 % 7).cast("decimal(12,4)").alias("price_per_mtok"),
    )


_PROVIDERS = """
    SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'fake' ELSE 'openai_compat' END AS kind,
           CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'https://m' || s_suppkey END AS base_url, 'm' || s_suppkey % 5 AS model,
           substr(s_name, 1, CAST(s_suppkey % 25 AS INTEGER)) AS api_key, s_suppkey = 4 AS is_active, s_suppkey FROM supplier"""
_MASKED = "CASE WHEN length(api_key) > 4 THEN '****' || right(api_key, 4) ELSE '****' END AS key_masked"


@query(
    "provider_list",
    f"SELECT name, kind, base_url, model, {_MASKED}, is_active FROM ({_PROVIDERS}) ORDER BY is_active DESC, name",
)
def provider_list(t: Tables) -> DataFrame:
    return providers.listing(_providers(t))


@query(
    "provider_update",
    f"""SELECT name, kind, base_url, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE model END AS model, {_MASKED}, is_active
        FROM (SELECT * REPLACE (CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'secret-' || s_suppkey ELSE api_key END
              AS api_key) FROM ({_PROVIDERS}))""",
)
def provider_update(t: Tables) -> DataFrame:
    key = F.substring("name", 10, 9).cast("int")
    changes = _providers(t).filter(key % 3 == 0).select(
        "name", "kind", "base_url", F.lit(" new ").alias("model"),
        F.when(key % 2 == 0, F.concat(F.lit("secret-"), key.cast("string"))).otherwise("").alias("api_key"),
    )
    return providers.listing(providers.update(_providers(t), changes))


@query("active_provider", f"SELECT name, model FROM ({_PROVIDERS}) WHERE is_active")
def active_provider(t: Tables) -> DataFrame:
    return providers.active(_providers(t)).select("name", "model")


@query(
    "post_source_ids",
    """SELECT d.doc_id, s.id AS source_id FROM documents d JOIN source_v s ON s.name = d.source WHERE s.enabled""",
    ("source_v",),
)
def post_source_ids(t: Tables) -> DataFrame:
    posts = t.documents.select("doc_id", F.col("source").alias("source_name"))
    return landed.with_source_ids(posts, t.source.filter("enabled"))[0].select("doc_id", "source_id")


@query("unknown_sources", "SELECT source AS source_name, count(*) AS rows FROM documents WHERE source = 'src3' GROUP BY source")
def unknown_sources(t: Tables) -> DataFrame:
    posts = t.documents.select("doc_id", F.col("source").alias("source_name"))
    return landed.with_source_ids(posts, t.source.filter("enabled"))[1]
