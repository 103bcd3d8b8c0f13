"""Registered queries against their SQL over a few given rows that the small tables lack."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_point


def compared(spark, folder, name, **tables):
    """The query's rows; they must be those of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = entry_point.queries()[name](spark, str(folder))
    result = con.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
    return got


CUT_TITLE = "<html><title>Salt &amp</title><body><h1>Salt &amp;&amp</h1><p>more &amp; more</p></body></html>"


@pytest.mark.parametrize("name", ["page_text", "page_text_health", "feed_posts"])
def test_page_cut_within_a_reference(spark, tmp_path, name):
    urls = ["https://a.example/1?x=1&utm_source=q", "https://a.example/2", "https://b.example/3"]
    compared(spark, tmp_path, name, pages={"page_id": [1, 2, 3], "url": urls, "html": [CUT_TITLE, CUT_TITLE.replace("&amp<", "<"), CUT_TITLE * 20]})


def test_half_a_micro_unit(spark, tmp_path):
    # Five characters at 0.5 a million.
    talk = {"conv_id": [2, 6, 1], "role": ["user", "assistant", "user"], "text": ["abcd", "e", "ab"]}
    assert ("m2", 5, 2.5e-06, 3) in compared(spark, tmp_path, "model_cost", conversations=talk)


def test_a_cluster_has_its_share_of_all_documents(spark, tmp_path):
    documents = {"doc_id": list(range(240)), "text": [f"word{i} and more of {i}" for i in range(240)]}
    assert len(compared(spark, tmp_path, "cluster_checks", documents=documents)) == 240 // 12
