"""Registered corpus queries: the same rows as their SQL, and recall of the approximate one."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from palisade.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    got = QUERIES[name](spark, DIR)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_best_fit_packing", "op6_token_counts", "op7_warc", "op8_lattice_lm", "op9_simhash_dedup", "op10_source_mix"])
def test_every_row_comes_back(spark, name):
    table, key = ("pages", "page_id") if name == "op7_warc" else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect()}
    got = QUERIES[name](spark, DIR)
    assert {r[0] for r in got.select(key).distinct().collect()} == ids
    if name != "op5_best_fit_packing":
        assert got.count() == len(ids)


def test_forest_recall(spark):
    """Against brute force, with leaves so small that the table is split often."""
    from palisade.llm.embedding_forest import dedup_embeddings

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    links = ((v @ v.T >= 0.98) & (label[:, None] == label[None, :])).sum() - len(rows)
    found = sum(r.n_links for r in dedup_embeddings(table, leaf=32).collect())
    assert 0.9 * links <= found <= links
