"""Row order across parts: numbers, neighbours and running sums against plain lists."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logfathom.operators import order


@pytest.fixture(autouse=True)
def small_parts(spark):
    """Without it these small tables would be one part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_are_split_and_all_rows_are_numbered(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("t"), "id")  # two thirds nulls
    parts, sizes = order.parted(df, [F.col("t").asc_nulls_first()])
    assert len(sizes) > 2 and max(sizes.values()) < 2 * 30_000 / len(sizes)
    rows = sorted(order.numbered(df, [F.col("t").asc_nulls_first()]).collect(), key=lambda r: r["_rn"])
    assert [r["_rn"] for r in rows] == list(range(1, 30_001))
    assert all(r["t"] is None for r in rows[:20_000]) and [r["t"] for r in rows[20_000:]] == list(range(0, 30_000, 3))
    plan = order.numbered(df, [F.col("t")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_neighbours_and_sums(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 5000):
        rows = [(k, rng.choice([None, k * 2]), Decimal(k) / 4, k / 2, f"s{k}") for k in range(n)]
        df = spark.createDataFrame(rng.sample(rows, n), "id long, v int, m decimal(10,2), d double, s string").repartition(4)
        back, ahead = 3, 2
        got = order.neighbours(df, [F.col("id").asc()], {"p": (F.col("v"), back, None), "q": (F.col("s"), -ahead, "end"), "r": (F.col("v"), 1, -1), "z": (F.col("d"), 0, None)}).collect()
        got.sort(key=lambda r: r["id"])
        assert [r["id"] for r in got] == list(range(n))
        for k, r in enumerate(got):
            assert r["p"] == (rows[k - back][1] if k >= back else None) and r["q"] == (rows[k + ahead][4] if k + ahead < n else "end")
            assert r["r"] == (rows[k - 1][1] if k else -1) and r["z"] == rows[k][3] and r["s"] == f"s{k}"
        for name, at in (("v", 1), ("m", 2), ("d", 3)):
            total = 0
            for r in sorted(order.running_sum(df, [F.col("id").asc()], "t", F.col(name)).collect(), key=lambda r: r["id"]):
                total += rows[r["id"]][at] or 0
                assert r["t"] == total


def test_many_more_parts_than_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        df = spark.range(40).select("id")
        got = {r["id"]: (r["a"], r["b"]) for r in order.neighbours(df, [F.col("id").asc()], {"a": (F.col("id"), 5, -1), "b": (F.col("id"), -4, -2)}).collect()}
        assert got == {k: (k - 5 if k >= 5 else -1, k + 4 if k < 36 else -2) for k in range(40)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
