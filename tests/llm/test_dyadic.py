import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import dyadic
from assay.operators import ranks

SPEC = dyadic.DEFAULT


def test_codes_keep_order_and_bound_the_error(spark):
    values = sorted([0.0, 1e-12, -1e-12, 1.0, 2.0, 3.999999, 4.0, 1e9, -1.0, -7.3, 1e30, -1e30, 0.001, 1770800.0, *np.exp(np.random.default_rng(0).normal(5, 4, 500)).tolist(), *(2.0**k for k in range(-12, 40))])
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(dyadic.code_column(F.col("v")).alias("c")).collect()]
    assert got == sorted(got) and min(got) >= 0 and max(got) < SPEC.universe
    low, high = dyadic.code_low(np.array(got)), dyadic.code_high(np.array(got))
    for v, a, b in zip(values, low, high, strict=True):
        if 2.0**-10 <= abs(v) < 2.0**38:
            assert a <= v <= b and b - a <= 2.0**-10 * abs(v) * 1.01


def rows(spark, n=6000, seed=1):
    rng = np.random.default_rng(seed)
    data = [("hot" if rng.random() < 0.5 else f"g{int(rng.integers(0, 5))}", int(rng.integers(0, 4)), float(np.exp(rng.normal(7, 1)))) for _ in range(n)]
    return data, spark.createDataFrame(data, "g string, day int, v double")


def test_brackets_hold_the_true_percentiles(spark):
    data, df = rows(spark)
    for r in dyadic.percentiles(dyadic.build(df, ["g"], "v"), [0.05, 0.5, 0.95]).collect():
        own = np.array([v for g, _, v in data if g == r.g])
        assert r.n == len(own)
        for p in (0.05, 0.5, 0.95):
            true, name = np.percentile(own, 100 * p), f"p{round(p * 1000):03d}"
            assert r[f"{name}_low"] <= true <= r[f"{name}_high"]
            rank = np.searchsorted(np.sort(own), r[name]) / len(own)
            assert abs(rank - p) < 0.03


def test_days_add_up_to_the_whole_and_deletions_undo(spark):
    data, df = rows(spark)
    whole = {r.g: bytes(r.sketch) for r in dyadic.build(df, ["g"], "v").collect()}
    days = dyadic.merge(dyadic.build(df, ["g", "day"], "v"), ["g"])
    assert {r.g: bytes(r.sketch) for r in days.collect()} == whole
    doubled = df.withColumn("w", F.lit(2)).unionByName(df.withColumn("w", F.lit(-1)))
    assert {r.g: bytes(r.sketch) for r in dyadic.build(doubled, ["g"], "v", "w").collect()} == whole
    gone = df.withColumn("w", F.lit(1)).unionByName(df.withColumn("w", F.lit(-1)))
    for r in dyadic.percentiles(dyadic.build(gone, ["g"], "v", "w"), [0.5]).collect():
        assert r.n == 0 and r.p500 is None
    everything = dyadic.merge(dyadic.build(df, ["g"], "v"), [])
    assert everything.first().n == len(data)


def test_exact_percentiles_and_brackets_that_miss(spark):
    """Also of the group that holds half of all rows, which is then ordered whole, range by range."""
    data, df = rows(spark, 3000)
    sketched = dyadic.percentiles(dyadic.build(df, ["g"], "v"), [0.5, 0.95])
    wrong = {"p500_low": 0.0, "p500_high": 1.0, "p950_low": 1e9, "p950_high": 1e9}
    poor = sketched.withColumns({c: F.when(F.col("g").isin("hot", "g1") if c < "p9" else F.col("g") == "g2", F.lit(v)).otherwise(F.col(c)) for c, v in wrong.items()})
    got = {(r.g, r["name"]): r.percentile for r in dyadic.exact_percentiles(df, ["g"], "v", poor, [0.5, 0.95]).collect()}
    groups = {g for g, _, _ in data}
    assert set(got) == {(g, n) for g in groups for n in ("p500", "p950")}
    for (g, name), value in got.items():
        assert value == pytest.approx(np.percentile([v for h, _, v in data if h == g], int(name[1:]) / 10), rel=1e-12)


def test_only_rows_inside_brackets_are_shuffled(spark):
    _, df = rows(spark, 3000)
    brackets = dyadic.percentiles(dyadic.build(df, ["g"], "v"), [0.5])
    plan = dyadic._bracketed(df, ["g"], "v", dyadic.cut(brackets), [0.5])
    assert plan.count() == 6 and "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_many_brackets_are_joined_by_a_shuffle(spark, monkeypatch):
    data, df = rows(spark, 2000)
    df = df.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))  # a null key too
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    got = {r.g: r.percentile for r in dyadic.exact_percentiles(df, ["g"], "v", dyadic.percentiles(dyadic.build(df, ["g"], "v"), [0.5]), [0.5]).collect()}
    for g, value in got.items():
        assert value == pytest.approx(np.percentile([v for h, _, v in data if (None if h == "g3" else h) == g], 50), rel=1e-12)
    assert len(got) == 6


@pytest.mark.parametrize("shape", ["wide", "narrow", "lumps"])
def test_rank_errors_stay_within_the_stated_deviation(shape):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        codes = np.clip({"wide": rng.normal(50_000, 9000, 40_000), "narrow": rng.normal(50_000, 60, 40_000), "lumps": np.where(rng.random(40_000) < 0.5, rng.normal(40_000, 9, 40_000), rng.normal(60_000, 30, 40_000))}[shape], 0, SPEC.universe - 1).astype(int)
        codes.sort()
        sketch = dyadic.empty_sketch()
        dyadic.add(sketch, *np.unique(codes, return_counts=True))
        at = np.round(np.array([0.05, 0.25, 0.5, 0.75, 0.95]) * (len(codes) - 1))
        found, deviation = dyadic.invert(np.repeat(sketch[None], 5, axis=0), at)
        off = np.maximum(np.searchsorted(codes, found) - at, at - np.searchsorted(codes, found, "right"))
        assert (off <= 4 * deviation + 1).all()


def test_odd_values_null_keys_and_empty(spark):
    df = spark.createDataFrame([(None, 5.0), (None, math.nan), ("a", None), ("a", math.inf), ("b", 0.0), ("b", -3.0), ("b", -3.0)], "g string, v double")
    got = {r.g: (r.n, r.p500) for r in dyadic.percentiles(dyadic.build(df, ["g"], "v"), [0.5]).collect()}
    assert got[None][0] == 1 and got[None][1] == pytest.approx(5.0) and "a" not in got and got["b"] == (3, pytest.approx(-3.0, rel=1e-3))
    assert dyadic.percentiles(dyadic.build(df.limit(0), ["g"], "v"), [0.5]).count() == 0


def test_packing_of_sketches():
    for n in (0, 3, 100_000):
        sketch = dyadic.empty_sketch()
        dyadic.add(sketch, np.random.default_rng(n).integers(0, SPEC.universe, n), np.ones(n, dtype=int))
        assert (dyadic.unpack(dyadic.pack(sketch)) == sketch).all()


def test_few_codes_stay_codes_and_give_the_same_counters():
    rng = np.random.default_rng(7)
    few, many = rng.integers(0, SPEC.universe, 300), rng.integers(0, SPEC.universe, 9000)
    for codes in (few, many, np.zeros(0, dtype=int)):
        want = dyadic.empty_sketch()
        dyadic.add(want, codes, np.ones(len(codes), dtype=int))
        whole, parts = dyadic.Gatherer(SPEC), dyadic.Gatherer(SPEC)
        whole.rows(codes, np.ones(len(codes), dtype=np.int64))
        for piece in np.array_split(codes, 5):
            one = dyadic.Gatherer(SPEC)
            one.rows(piece, np.ones(len(piece), dtype=np.int64))
            parts.packed(one.result())
        assert (dyadic.unpack(whole.result()) == want).all() and whole.result() == parts.result()


def test_coarse_bounds_are_certain(spark):
    data, df = rows(spark)
    poor = dyadic.SketchSpec(width=2, depth=1)
    missed = 0
    for r in dyadic.percentiles(dyadic.build(df, ["g"], "v", spec=poor), [0.05, 0.5, 0.95], 0.0, poor, certain=True).collect():
        for p in ("p050", "p500", "p950"):
            true = np.percentile([v for g, _, v in data if g == r.g], int(p[1:]) / 10)
            missed += not r[f"{p}_low"] <= true <= r[f"{p}_high"]
            assert r[f"{p}_least"] <= true <= r[f"{p}_most"]
    assert missed  # the narrow brackets of so poor a sketch do not hold


def test_odd_values_within_coarse_bounds(spark):
    for values in ([-1e30, -5.0], [0.0, 1e-12, -1e-12], [1e30, 1e31], [7.0]):
        r = dyadic.percentiles(dyadic.build(spark.createDataFrame([(v,) for v in values], "v double"), [], "v"), [0.5], certain=True).first()
        assert r.p500_least <= np.percentile(values, 50) <= r.p500_most
