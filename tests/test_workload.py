"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import functools
import re

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# The corpus operators have tests of their own.
QUERIES = {n: q for n, q in entry_point.queries().items() if n in entry_point.QUERIES}
# Queries that run Python inside tasks: encoders and vector products.
WITH_PYTHON = {
    "encode_documents", "embedding_backfill", "nearest_leaders",
    "cluster_recompute", "leader_clusters", "leader_clusters_default", "leader_cluster_sizes", "cluster_stage", "cluster_titles",
}


@functools.cache
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_checking_sql():
    assert set(QUERIES) <= set(entry_point.oracle_sql())
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d", n)]


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["cluster_id", "size"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    result = duck().execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert got == wanted

    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[.*\], \[[^\]]*\]\n", plan) or "WindowGroupLimit" in plan
    assert "SinglePartition, REPARTITION" not in plan
    if name not in WITH_PYTHON:
        assert not re.search(r"(BatchEval|ArrowEval|MapIn)", plan)


def test_every_document_is_gathered(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    gathered = {n: sum(r["rows"] for r in q(spark, FOLDER).collect()) for n, q in QUERIES.items() if n.startswith("gather_")}
    assert max(gathered.values()) == documents.count()
