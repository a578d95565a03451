"""Scans over dense and sparse keys, with few blocks and with a tree of them."""

import random

import pytest
from pyspark.sql import functions as F

from quillstrand.operators import scan

SPREAD = {
    "dense": lambda i: i - 700,
    "hashes": lambda i: random.Random(i).randrange(-(1 << 63), 1 << 63),
    "times": lambda i: 1_700_000_000_000_000_000 + i * 1_000_003,
}


@pytest.mark.parametrize("spread", sorted(SPREAD))
@pytest.mark.parametrize("group", [1 << 16, 3])
def test_scans(spark, monkeypatch, spread, group):
    monkeypatch.setattr(scan, "GROUP", group)
    keys = sorted({SPREAD[spread](i) for i in range(2000)})
    rows = [(k, i % 7 if i % 11 else None, "ab"[i % 2]) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key long, v long, g string").repartition(5)
    n = F.coalesce("v", F.lit(0).cast("long"))
    got = sorted(map(tuple, scan.running_sum(df.select("key", n.alias("v")), "key", {"s": F.col("v")}, size=64).collect()))
    total, want = 0, []
    for k, v, _ in rows:
        total += v or 0
        want.append((k, v or 0, total))
    assert got == want
    by = sorted(map(tuple, scan.running_sum(df.select("key", "g"), "key", {"s": F.lit(1)}, by=["g"], exclusive=True, size=64).select("key", "g", "s").collect()))
    assert by == [(k, g, i // 2) for i, (k, _, g) in enumerate(rows)]
    ids = sorted(map(tuple, scan.dense_id(df.select("key"), "key", "r", size=64).collect()))
    assert ids == [(k, i) for i, k in enumerate(keys)]
    lag = sorted(map(tuple, scan.lagged(df.select("key", "v"), "key", {"p": F.col("v"), "q": F.col("key")}, size=64).select("key", "p", "q").collect()))
    assert lag == [(k, None if i == 0 else rows[i - 1][1], None if i == 0 else keys[i - 1]) for i, k in enumerate(keys)]


def test_no_task_has_all_blocks(spark, monkeypatch):
    df = spark.range(3000).select((F.xxhash64("id")).alias("key"), F.lit(1).cast("long").alias("v"))
    for group in (1 << 16, 3):
        monkeypatch.setattr(scan, "GROUP", group)
        for out in (scan.running_sum(df, "key", {"s": F.col("v")}), scan.dense_id(df, "key", "r"), scan.lagged(df, "key", {"p": F.col("v")})):
            assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_nothing(spark):
    df = spark.createDataFrame([], "key long, v long")
    assert scan.running_sum(df, "key", {"s": F.col("v")}).count() == scan.dense_id(df, "key", "r").count() == scan.lagged(df, "key", {"p": F.col("v")}).count() == 0
