"""Alternating least squares by blocks against a plain version, and that against Spark's ALS."""

import random

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS

from sparkreco.operators import als

RANK, ROUNDS, REG = 4, 3, 0.01


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    users = [u - 5 for u in range(40)] + [1 << 40]
    return [(u, i, rng.random() * 5) for u in users for i in sorted(rng.sample(range(30), rng.randrange(1, 15)))]


def plain(rows, users):
    """Both sides' factors after the rounds, from the users' start."""

    def side(at, by, known):
        met = {}
        for r in rows:
            met.setdefault(r[at], []).append((known[r[by]], r[2]))
        return {k: np.linalg.solve((x := np.array([f for f, _ in m])).T @ x + REG * len(m) * np.eye(RANK), x.T @ np.array([w for _, w in m])) for k, m in met.items()}

    for _ in range(ROUNDS):
        items = side(1, 0, users)
        users = side(0, 1, items)
    return users, items


def close(found, want):
    assert found.keys() == want.keys()
    assert max(np.abs(found[k] - want[k]).max() for k in want) < 1e-3


def taken(df):
    return {r[0]: np.array(r[1], "f8") for r in df.collect()}


@pytest.mark.parametrize("blocks", [1, 5, None])
def test_blocks_equal_a_plain_version(spark, rows, blocks):
    """ids of any size, whatever the blocks, with more weights than the rank or fewer; nulls are left out."""
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (1, None, 1.0), (1, 29, None)], "user_id long, item_id long, weight double").repartition(3)
    ids = sorted({r[0] for r in rows})
    want = plain(rows, dict(zip(ids, als.start(np.array(ids), RANK, 42).astype("f8"), strict=True)))
    found = als.factors_by_block(df, RANK, ROUNDS, REG, 42, blocks)
    for f, w in zip(found, want, strict=True):
        close(taken(f), w)


def test_the_plain_version_equals_sparks(spark, rows):
    rows = [r for r in rows if r[0] < 1 << 31]
    df = spark.createDataFrame(rows, "user_id int, item_id int, weight float")
    fit = lambda n: ALS(rank=RANK, maxIter=n, regParam=REG, userCol="user_id", itemCol="item_id", ratingCol="weight", seed=42).fit(df)
    want, model = plain(rows, taken(fit(0).userFactors)), fit(ROUNDS)
    for f, w in zip((model.userFactors, model.itemFactors), want, strict=True):
        close(taken(f), w)


def test_blocks_are_dealt_to_a_partition_each(spark):
    for n in (1, 8, 37):
        df = spark.createDataFrame([(k,) for k in als._keys(spark, n)], "block int").repartition(n, "block")
        assert df.rdd.glom().map(len).collect() == [1] * n
    assert [als.blocks_for(n, 12) for n in (0, 6_000_000, 6_000_001)] == [12, 12, 24]


def test_no_weights(spark):
    assert [df.count() for df in als.factors_by_block(spark.createDataFrame([], "user_id long, item_id long, weight double"), RANK)] == [0, 0]


def test_half_rounds_leave_no_copies_behind(spark, rows, monkeypatch):
    """every half round's copies of factors stayed on the executors' disks until the last one was done."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: disk.getAllFiles().mkString(",").count("shuffle_")
    kept, staged = [], als.staged
    monkeypatch.setattr(als, "staged", lambda df, name, *options: (out := staged(df, name, *options), kept.append((name, shuffles())))[0])
    als.factors_by_block(spark.createDataFrame(rows, "user_id long, item_id long, weight double"), RANK, ROUNDS, REG, 42, 5)
    left = [n for name, n in kept if name == "factors"]
    assert len(left) == 2 * ROUNDS and left[-1] <= left[1]
