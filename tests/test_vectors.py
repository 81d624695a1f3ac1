"""The vector index against brute force: exact in any number of cells, probed with a measured recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreco.operators import vectors as V
from sparkreco.operators.vectors import VectorIndex

SCHEMA = "item_id long, vector array<double>"


def _table(spark, clustered, n=400, dims=8):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(n, dims))
    if clustered:
        rows = np.repeat(rng.normal(size=(n // 20, dims)), 20, axis=0) + 0.05 * rows
    rows[5] = rows[6]  # equal vectors
    data = [(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None), (901, [0.0] * dims)]
    return spark.createDataFrame(data, SCHEMA).repartition(3), rows


def _brute(rows, queries, k):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    out = {}
    for q in queries:
        cos = np.round(unit @ unit[q], 4) + 0.0
        best = [i for i in np.lexsort((np.arange(len(rows)), -cos)) if i != q][:k]
        out[q] = [(int(i), r + 1) for r, i in enumerate(best)]
    return out


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("probes", [1, 3, 100])
def test_exact_search(spark, tmp_path, clustered, probes, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 10)
    monkeypatch.setattr(V, "QUERY_ROWS", 4)
    df, rows = _table(spark, clustered)
    index = VectorIndex.build(df, str(tmp_path / "index"))
    queries = df.filter(F.col("item_id") % 9 == 0)
    got = {}
    for r in VectorIndex.open(spark, str(tmp_path / "index")).search(queries, 7, probes).collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["rank"]))
    assert {q: sorted(x, key=lambda y: y[1]) for q, x in got.items()} == _brute(rows, range(0, 400, 9), 7)
    compared = index.found(queries, 7, probes).agg(F.sum("compared")).first()[0]
    assert compared <= 45 * 400 and (not clustered or probes > 3 or compared < 45 * 400 / 4)


def test_probed_search_finds_nine_of_ten(spark, tmp_path):
    df, rows = _table(spark, True)
    index = VectorIndex.build(df, str(tmp_path / "index"))
    queries = df.filter(F.col("item_id") % 9 == 0)
    near = {(r["query_id"], r["item_id"]) for r in index.search(queries, 7, 4, exact=False).collect()}
    true = {(q, i) for q, x in _brute(rows, range(0, 400, 9), 7).items() for i, _ in x}
    assert len(near & true) >= 0.9 * len(true)


def test_search_reads_the_cells_it_asks_for(spark, tmp_path):
    df, _ = _table(spark, True)
    index = VectorIndex.build(df, str(tmp_path / "index"))
    plan = index.search(df.filter("item_id = 3"), 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert VectorIndex.build(empty, str(tmp_path / "index")).search(empty, 3).collect() == []


def test_queries_go_to_parts_and_not_to_cells(spark, tmp_path, monkeypatch):
    """Where bounds prune nothing a query went to every cell, with its vector, and came back with k rows of each."""
    monkeypatch.setattr(V, "PART_ROWS", 200)
    df, rows = _table(spark, False)
    index = VectorIndex.build(df, str(tmp_path / "index"))
    queries = df.filter(F.col("item_id") % 9 == 0)
    parts = 400 // 200 + 1
    assert index.cells.count() > 4 * parts
    assert index.found(queries, 7, 1).count() <= 45 * 7 * 2 * parts
    got = {}
    for r in index.search(queries, 7, 1).collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["rank"]))
    assert {q: sorted(x, key=lambda y: y[1]) for q, x in got.items()} == _brute(rows, range(0, 400, 9), 7)


def test_parts_grow_and_searches_leave_no_shuffles(spark, tmp_path, monkeypatch):
    """a query moved once for every 16,384 vectors, and what had moved stayed on disk beside the next step's."""
    monkeypatch.setattr(V, "PART_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(600)], SCHEMA)
    index = VectorIndex.build(rows, str(tmp_path / "grown"))
    assert 12 <= index._layout()[4].sum() <= 30  # sixty and more before
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString(",").split(",") if "shuffle_" in f}
    steps, stage = [], V.stage
    monkeypatch.setattr(V, "stage", lambda df, name: (before := shuffles(), stage(df, name), steps.append(shuffles() - before))[1])
    index.found(rows.filter("item_id < 50"), 3)
    assert steps == [set()]
