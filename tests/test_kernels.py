import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import scalars
from assay.operators import blocks, encode, kernels, ranks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def auc_by_hand(y, p):
    pos, neg = [b for a, b in zip(y, p, strict=True) if a], [b for a, b in zip(y, p, strict=True) if not a]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_nulls_and_one_class(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300).tolist(), (rng.integers(0, 12, 300) / 12).tolist()
    df = frame(spark, [*zip(y, p, strict=True), (1, None), (None, 0.5), (1, math.nan)], "y int, p double")
    assert kernels.auc(df, "y", "p").first().auc == pytest.approx(auc_by_hand(y, p), abs=1e-12)
    assert kernels.auc(df.filter("y = 1"), "y", "p").first().auc is None
    assert kernels.auc(df.limit(0), "y", "p").first().auc is None


def test_calibration_edges(spark):
    scores = [0.0, 0.1, 0.3, 0.6, 0.7, 1.0, 0.95, 0.29999, 0.7000000000000001]
    y = [0, 1, 0, 1, 1, 1, 0, 1, 0]
    edges = np.linspace(0, 1, 11)
    at = np.digitize(scores, edges) - 1
    want = sum(abs(np.mean(np.array(scores)[at == b]) - np.mean(np.array(y)[at == b])) * (at == b).sum() / len(y) for b in range(10) if (at == b).any())
    row = kernels.calibration(frame(spark, list(zip(y, scores, strict=True)), "y int, p double"), "y", "p").first()
    assert list(edges) == list(kernels.EDGES)
    assert row.expected_calibration_error == pytest.approx(want, abs=1e-12)
    assert row.brier_score == pytest.approx(np.mean((np.array(scores) - y) ** 2), abs=1e-12)


def test_fairness_with_null_group_and_group_without_positives(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("b", 0, 1), (None, 1, 1)]
    df = frame(spark, rows, "g string, y int, pred int")
    assert kernels.demographic_parity(df, "g", "y").first().demographic_parity == pytest.approx(2 / 3)
    row = kernels.group_quality(df, "g", "y", "pred").first()
    assert row.equal_opportunity == pytest.approx(0.5) and row.subgroup_performance == pytest.approx((1 / 3) / (2 / 5))
    empty = kernels.group_quality(df.limit(0), "g", "y", "pred").first()
    assert (empty.equal_opportunity, empty.subgroup_performance) == (0.0, 1.0)


def test_tail_coverage(spark):
    rng = np.random.default_rng(2)
    real, synthetic = rng.normal(0, 1, (400, 2)), rng.normal(0, 0.8, (300, 2))
    scores = []
    for j in range(2):
        lo, hi = np.percentile(real[:, j], [5, 95])
        tail = real[:, j][(real[:, j] < lo) | (real[:, j] > hi)]
        scores.append(np.mean((tail >= synthetic[:, j].min()) & (tail <= synthetic[:, j].max())))
    r, s = (frame(spark, x.tolist(), "a double, b double") for x in (real, synthetic))
    assert kernels.tail_coverage(r, s, ["a", "b"]).first().tail_coverage == pytest.approx(np.mean(scores), abs=1e-12)
    flat = frame(spark, [(1.0, 1.0)] * 5, "a double, b double")
    assert kernels.tail_coverage(flat, flat, ["a", "b"]).first().tail_coverage == 1.0


def test_rare_class_ties_go_to_the_first_row(spark):
    df = frame(spark, [(2, 0), (1, 1), (3, 1), (4, 0), (5, None)], "rid int, y int")
    assert kernels.minority(df, "y", "rid").first().minority == 1
    assert kernels.rare_coverage(df, df.filter("y = 0"), "y", "rid").first().rare_event_coverage == 0.0


def nearest_by_hand(points, queries, exclude):
    out = {}
    for i, q in queries:
        d = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for j, p in points if not (exclude and i == j)]
        if d:
            out[i] = math.sqrt(min(d))
    return out


@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_distance_is_exact(spark, exclude):
    rng = np.random.default_rng(3)
    vectors = np.round(np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(50, 0.01, (100, 3)), np.zeros((60, 3)), [[1e6, -1e6, 0]]]), 2)
    points = [(i, tuple(map(float, v))) for i, v in enumerate(vectors)]
    queries = points[::3] if exclude else [(1000 + i, tuple(map(float, rng.normal(0, 30, 3)))) for i in range(60)]
    make = lambda rows: frame(spark, [(i, *v) for i, v in rows], "id long, a double, b double, c double")
    bad = frame(spark, [(5000, None, 1.0, 1.0), (5001, math.nan, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double")
    got = blocks.nearest_distance(make(points).union(bad), make(queries).union(bad), "id", ["a", "b", "c"], exclude, blocks.BlockSpec(block_rows=32, queries_per_task=16))
    want = nearest_by_hand(points, queries, exclude)
    found = {r.id: r.distance for r in got.collect()}
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_an_index_answers_several_tables(spark):
    rng = np.random.default_rng(13)
    points = [(i, tuple(map(float, v))) for i, v in enumerate(rng.normal(0, 1, (250, 2)))]
    others = [(i, tuple(map(float, v))) for i, v in enumerate(rng.normal(0, 2, (80, 2)))]
    make = lambda rows: frame(spark, [(i, *v) for i, v in rows], "id long, a double, b double")
    index = blocks.NearestIndex(make(points), "id", ["a", "b"], blocks.BlockSpec(block_rows=40))
    for asked, other_id in ((points, True), (others, False)):
        found = {r.id: r.distance for r in index.nearest(make(asked).withColumn("distance", F.lit("clash")), other_id).collect()}
        assert found == pytest.approx(nearest_by_hand(points, asked, other_id))


def test_trees_route_like_their_ranges():
    rng = np.random.default_rng(14)
    sample = np.vstack([rng.normal(0, 1, (500, 3)), np.zeros((200, 3))])
    splits = blocks.fit_splits(sample, 37)
    block = splits.block(sample)
    assert len(splits.leaves) == len(set(block)) <= 37 and (splits.left[splits.leaves] == np.arange(len(splits.leaves))).all()
    queries, reach = rng.normal(0, 1, (40, 3)), rng.random(40)
    got = set(zip(*(x.tolist() for x in splits.meets(queries, reach)), strict=True))
    near = {(q, int(b)) for q in range(40) for b in set(block[(np.abs(sample - queries[q]) <= reach[q]).all(axis=1)])}
    assert near <= got and len(got) < 40 * len(splits.leaves)
    n = len(splits.leaves)
    low, high = (np.array([f(sample[block == b], axis=0) for b in range(n)]) for f in (np.min, np.max))
    boxes = blocks.Ranges(splits, np.bincount(block, minlength=n), low, high).boxes(60)
    for b in range(n):
        assert ((sample >= boxes[0][b]) & (sample <= boxes[1][b])).all(axis=1).sum() >= 60
    assert not np.isfinite(blocks.Ranges(splits, np.bincount(block, minlength=n), low, high).boxes(10**6)[0]).any()


def test_nearest_distance_of_few_rows(spark):
    one = frame(spark, [(1, 0.0, 0.0)], "id long, a double, b double")
    assert blocks.nearest_distance(one, one, "id", ["a", "b"], True).count() == 0
    assert blocks.nearest_distance(one.limit(0), one, "id", ["a", "b"], False).count() == 0


def test_privacy_of_a_copy(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(0, 1, (81, 2)))]
    df = frame(spark, rows, "rid long, a double, b double")
    row = kernels.privacy(df, df, "rid", ["a", "b"]).first()
    assert row.duplicate_rate == 1.0 and row.nn_distance_ratio == 0.0 and row.membership_inference == pytest.approx(abs(40 / 81 - 0.5) * 2)


def test_positions_and_scales(spark):
    df = frame(spark, [(i, float(i % 7)) for i in range(500)], "rid int, x double").repartition(7)
    got = ranks.positions(df, ["x", "rid"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [(r.x, r.rid) for r in got] == sorted((float(i % 7), i) for i in range(500))
    row = encode.scales(df.withColumn("k", F.lit(2.0)), ["x", "k"]).first()
    assert row.x_std == pytest.approx(statistics.pstdev(i % 7 for i in range(500))) and row.k_std == 1.0


def test_one_hot_and_align(spark):
    a = frame(spark, [(1, "m"), (2, None)], "rid int, s string")
    b = frame(spark, [(3, "f", 1.0)], "rid int, s string, z double")
    rows = {r.rid: r for r in encode.align(a, b, ["s"]).collect()}
    assert (rows[1].s_m, rows[2].s_m, rows[3].s_m) == (1.0, 0.0, 0.0) and rows[1].z is None and rows[3].src == "s"
    with pytest.raises(ValueError):
        encode.align(a.withColumn("src", F.lit(1)), b, [])


def test_normal_functions(spark):
    nd = statistics.NormalDist()
    points = [-6.0, -2.5, -0.3, 0.0, 0.7, 3.1]
    got = frame(spark, [(x,) for x in points], "x double").select("x", scalars.normal_cdf(F.col("x")).alias("c")).collect()
    assert all(abs(r.c - nd.cdf(r.x)) < 1e-6 for r in got)
    shares = [0.001, 0.2, 0.5, 0.9, 0.9999]
    got = frame(spark, [(p,) for p in shares], "p double").select("p", scalars.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - nd.inv_cdf(r.p)) < 5e-3 for r in got)
    sample = [r.z for r in spark.range(4000).select(scalars.normal("t", F.col("id")).alias("z")).collect()]
    assert abs(statistics.mean(sample)) < 0.06 and abs(statistics.stdev(sample) - 1) < 0.05


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    values = np.round(rng.lognormal(3, 1, 30_001), 2)
    df = frame(spark, [(float(v),) for v in values] + [(None,), (math.nan,)], "v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.9501, 1.0]
    row = ranks.exact_quantiles(df, "v", shares, [f"q{i}" for i in range(5)]).first()
    assert list(row) == pytest.approx(np.percentile(values, [100 * p for p in shares]).tolist(), rel=1e-12)
    assert ranks.exact_quantiles(df.limit(0), "v", [0.5], ["q"]).first().q is None


def test_quantiles_by_group_with_a_hot_and_a_null_key(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 4}", float(v)) for i, v in enumerate(rng.normal(0, 5, 1500))]
    df = frame(spark, rows, "g string, v double")
    for most in (100_000, 0):
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", most)
        got = {r.g: (r.n, r.a, r.b) for r in ranks.quantiles(df, ["g"], "v", [0.1, 0.5], ["a", "b"]).collect()}
        assert len(got) == 6
        for g, found in got.items():
            own = [v for k, v in rows if k == g]
            assert found == pytest.approx((len(own), *np.percentile(own, [10, 50])), rel=1e-12)


def test_splits_take_their_share_of_each_class(spark):
    rows = [(i, 1 if i % 10 == 0 else None if i % 17 == 0 else 0) for i in range(530)]
    df = encode.folds(encode.holdout(frame(spark, rows, "k long, y int").repartition(5), ["y"], "k", 0.4), ["y"], "k", 3)
    got = df.collect()
    assert sorted(r.k for r in got) == list(range(530))
    for y in (0, 1, None):
        own = [r for r in got if r.y == y]
        assert sum(r.is_test for r in own) == math.floor(len(own) * 0.4 + 0.5)
        sizes = [sum(r.fold == f for r in own) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1
    again = encode.holdout(frame(spark, rows[::-1], "k long, y int").repartition(3), ["y"], "k", 0.4)
    assert {r.k for r in again.filter("is_test").collect()} == {r.k for r in got if r.is_test}
    assert encode.holdout(df.limit(0).drop("is_test"), ["y"], "k", 0.4).count() == 0


def test_fairness_without_groups_or_classes(spark):
    df = frame(spark, [("a", 1, 5.0), ("b", 1, 6.0), (None, 1, 7.0)], "g string, y int, x double")

    def never(_):
        raise AssertionError("no model is asked")

    for group in (None, "gone"):
        assert kernels.fairness(df, group, "y", never).first().asDict() == kernels.NO_GROUPS
    assert kernels.fairness(df, "g", "y", never).first().asDict() == {"demographic_parity": 0.0, **kernels.ONE_CLASS}
    assert kernels.fairness(df.limit(0), "g", "y", never).first().asDict() == {"demographic_parity": 0.0, **kernels.ONE_CLASS}
    two = df.union(frame(spark, [("a", 0, 1.0)], "g string, y int, x double"))
    row = kernels.fairness(two, "g", "y", lambda d: d.withColumn("pred", F.lit(1))).first()
    assert row.demographic_parity == 0.5 and row.equal_opportunity == 0.0


def test_running_sum(spark):
    df = frame(spark, [(i, i % 5) for i in range(200)], "k int, x int").repartition(6)
    got = {r.k: r.s for r in ranks.running_sum(df, ["k"], "x", "s").collect()}
    assert got == {k: sum(i % 5 for i in range(k)) for k in range(200)}
    assert ranks.running_sum(df.limit(0), ["k"], "x", "s").count() == 0
