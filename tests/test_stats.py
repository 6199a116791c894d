"""Quantiles, duplicates, samples; one key holding a third of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.operators import joins, stats


def skewed(spark, n=6000):
    """A third of the rows share one key; keys may be NULL."""
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 17)
    value = F.round((F.col("id") * 7919 % 1013) / 10 + F.col("id") % 3, 2)
    return spark.range(n).select(key.cast("int").alias("k"), value.alias("v"), "id")


@pytest.mark.parametrize("width", [0.05, 5.0, 1000.0])
def test_quantiles_are_exact(spark, width):
    df = skewed(spark)
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    got = {r["k"]: r for r in stats.exact_quantiles(df, "v", probs, ["k"], bucket_width=width).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    assert set(got) == set(groups) and None in got
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_of_everything_skip_nulls(spark):
    df = skewed(spark).select(F.when(F.col("v") > 3, F.col("v")).alias("v"))
    values = [r["v"] for r in df.collect() if r["v"] is not None]
    out = stats.exact_quantiles(df, "v", {"m": 0.5}, bucket_width=1.0).collect()
    assert len(out) == 1
    assert (out[0]["m"], out[0]["n"]) == (pytest.approx(np.median(values)), len(values))


def test_quantiles_read_their_input_once(spark, folder):
    skewed(spark).write.parquet(f"{folder}/t")
    out = stats.exact_quantiles(spark.read.parquet(f"{folder}/t"), "v", {"m": 0.5}, ["k"], bucket_width=1.0)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_value_range(spark):
    row = stats.value_range(spark.createDataFrame([(-5.0,), (3.0,), (None,)], "v double"), "v").first()
    assert tuple(row) == (-5.0, 3.0, 5.0)


def test_duplicates_keep_every_copy(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, y string")
    hot = spark.range(3000).select(F.lit(1).alias("x"), F.lit("a").alias("y"))
    df = base.unionByName(hot).unionByName(base.where("x = 2"))
    out = stats.duplicate_rows(df, ["x", "y"])
    assert {tuple(r[:3]): r["n"] for r in out.groupBy("x", "y", "copies").agg(F.count("*").alias("n")).collect()} == {
        (1, "a", 3001): 3001,
        (2, None, 2): 2,
    }


def test_busiest_keeps_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (None,), (None,), (None,)], "k int")
    assert sorted(tuple(r) for r in stats.busiest(df, "k").collect()) == [(1, 2), (2, 2)]


def test_sample_is_reproducible(spark):
    df = skewed(spark)
    rank = F.xxhash64("id", F.lit(42))
    one = {r["id"] for r in stats.sample_rows(df, 50, rank, "id").collect()}
    two = {r["id"] for r in stats.sample_rows(df.repartition(7), 50, rank, "id").collect()}
    assert one == two and len(one) == 50
    assert one != {r["id"] for r in stats.sample_rows(df, 50, F.xxhash64("id", F.lit(7)), "id").collect()}


def test_set_checks(spark):
    a, b = spark.range(0, 5).toDF("k"), spark.range(3, 8).toDF("k")
    assert {r["k"]: r["in_a"] for r in stats.only_in_one(a, b, "k").collect()} == {0: True, 1: True, 2: True, 5: False, 6: False, 7: False}
    assert sorted(r[0] for r in stats.missing_ids(a, b, "k").collect()) == [0, 1, 2]


def test_broadcast_only_below_the_limit(spark):
    side = spark.range(100)

    def hinted(**options):
        df = joins.broadcast_if_small(side, **options)
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(at_most_rows=1000)
    assert not hinted(at_most_rows=10**9)
    assert hinted(limit_bytes=100 * 64)
    assert not hinted(limit_bytes=100 * 64 - 1)
    assert not hinted(row_weight=F.col("id"), limit_bytes=4949)
    assert hinted(row_weight=F.col("id"), limit_bytes=4950)


def test_wide_rows_are_measured_before_a_broadcast(spark):
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 100_000).alias("t"), F.array("id").alias("a"))
    assert joins.broadcast_if_small(wide, limit_bytes=3_000_000) is wide
    assert joins.broadcast_if_small(wide, at_most_rows=40, limit_bytes=3_000_000) is wide
    assert joins.broadcast_if_small(wide, limit_bytes=5_000_000) is not wide
    assert joins.broadcast_if_small(spark.range(40), limit_bytes=3_000) is not wide


def spread_values():
    rng = np.random.default_rng(4)
    tiny = [5e-324, 1e-300, -1e-300, 1e300, -1.7e308, 1.7e308, 0.0, -0.0]
    return {
        "even": rng.uniform(-3, 9, 1001).tolist(),
        "wide": np.exp(rng.normal(0, 40, 800)).tolist(),
        "both": (np.exp(rng.normal(0, 30, 700)) * rng.choice([-1, 1], 700)).tolist(),
        "ties": rng.integers(0, 5, 900).astype(float).tolist(),
        "extreme": tiny * 3,
        "negative": (-np.exp(rng.normal(0, 9, 500))).tolist(),
        "one": [7.25],
        "same": [2.0] * 50,
    }


PROBS = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q100": 1.0}


def by_hand(values):
    out = {}
    ordered = sorted(values)
    for name, p in PROBS.items():
        at = (len(ordered) - 1) * p
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        out[name] = low + (high - low) * (at - math.floor(at))
    return out


@pytest.mark.parametrize("buckets", [64, 1024])
def test_refined_quantiles_by_key(spark, buckets):
    groups = spread_values()
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    rows += [(None, 1.0), (None, 2.0), ("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in stats.refined_quantiles(df, "v", PROBS, ["k"], buckets=buckets).collect()}
    assert set(got) == {*groups, None}
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, want in by_hand(values).items():
            assert got[k][name] == pytest.approx(want, rel=1e-12, abs=0), (k, name)
    assert got[None]["q50"] == 1.5


def test_refined_quantiles_of_everything(spark):
    values = spread_values()["both"]
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "v double, w int")
    row = stats.exact_quantiles(df, "v", PROBS).first()
    assert {n: row[n] for n in PROBS} == pytest.approx(by_hand(values), rel=1e-12)
    weighted = stats.weighted_quantiles(df, "v", "w", PROBS).first()
    repeated = [v for i, v in enumerate(values) for _ in range(1 + i % 3)]
    assert weighted["n"] == len(repeated)
    assert {n: weighted[n] for n in PROBS} == pytest.approx(by_hand(repeated), rel=1e-12)
    empty = stats.refined_quantiles(df.where("false"), "v", {"q": 0.5}).collect()
    assert len(empty) == 1 and empty[0]["q"] is None


def test_refinement_never_gathers_everything_in_one_task(spark):
    df = spark.range(20000).select(F.sin("id").alias("v"))
    plan = stats.refined_quantiles(df, "v", {"q": 0.3})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the last step only picks what the rounds have found
