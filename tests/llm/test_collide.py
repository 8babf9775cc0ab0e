import math

import numpy as np
import pytest

from assay.llm import collide

SPREAD = {"a": 1.0, "b": 2.0, "c": 0.5, "d": 1.0}
SCHEMA = "id long, a double, b double, c double, d double"


def by_hand(rows, queries, k):
    scale = np.array([SPREAD[c] for c in "abcd"])
    ids, v = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]) / scale
    out = {}
    for q in queries:
        d2 = ((v - np.array(q[1:]) / scale) ** 2).sum(axis=1)
        d2[ids == q[0]] = np.inf
        best = [i for i in np.lexsort((ids, d2)) if d2[i] < np.inf][:k]
        out[q[0]] = [int(ids[i]) for i in best]
    return out


def data(seed=0):
    rng = np.random.default_rng(seed)
    crowd = np.round(rng.normal(0, 0.05, (300, 4)), 2)
    wide = np.round(rng.normal(0, 20, (200, 4)), 1)
    copies = np.tile([[1.0, 1.0, 1.0, 1.0]], (250, 1))
    far = np.array([[1e5, 0, 0, 0], [0, -1e5, 0, 3]])
    v = np.round(np.vstack([crowd, wide, copies, far]) * 64) / 64  # distances are exact, so ties are ties
    ids = rng.permutation(len(v))
    return [(int(i), *map(float, x)) for i, x in zip(ids, v, strict=True)]


@pytest.mark.parametrize("threshold", [1.0, 0.5])
def test_true_neighbours_with_ties_copies_and_outliers(spark, threshold):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    bad = spark.createDataFrame([(9001, None, 1.0, 1.0, 1.0), (9002, math.nan, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0), (9003, math.inf, 0.0, 0.0, 0.0)], SCHEMA)
    spec = collide.CollisionSpec(k=5, block_rows=48, queries_per_task=40, threshold=threshold, stretch=1.0)
    got = {}
    for r in collide.similar(df.union(bad), df.union(bad), "id", list("abcd"), SPREAD, spec).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.near_id)
    assert got == by_hand(rows, rows, 5)


def test_recall_where_windows_are_narrower_than_the_radius(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x)) for i, x in enumerate(np.vstack([rng.normal(0, 1, (1500, 4)), rng.normal(9, 0.01, (500, 4))]))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_hand(rows, rows[::5], 10)
    found = collide.similar(df, df.filter("id % 5 = 0"), "id", list("abcd"), SPREAD, collide.CollisionSpec(block_rows=300)).collect()
    assert len(found) == 4000 and collide.DEFAULT.threshold < 1 < collide.DEFAULT.stretch
    assert sum(r.near_id in want[r.query_id] for r in found) >= 0.99 * 4000


def test_only_those_that_collide_often_enough_are_verified():
    rng = np.random.default_rng(6)
    vectors, ids = rng.normal(0, 1, (3000, 4)), np.arange(3000)
    looked_at = []
    for threshold in (0.25, 0.625, 1.0):
        spec = collide.CollisionSpec(threshold=threshold)
        arrays = collide.Arrays(ids, vectors, collide.directions(4, spec), spec)
        before, seen = np.einsum, []
        np.einsum = lambda how, a, b, before=before, seen=seen: seen.append(len(a)) or before(how, a, b)
        try:
            list(arrays.search(ids[:50], vectors[:50], np.full(50, np.inf)))
        finally:
            np.einsum = before
        looked_at.append(sum(seen))
    assert looked_at[0] > 2 * looked_at[1] and looked_at[1] > looked_at[2]


def test_few_rows_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, "x"), (2, 1.0, 0.0, 0.0, 0.0, "y")], SCHEMA + ", rank string")
    got = collide.similar(df, df, "id", list("abcd"), SPREAD).collect()
    assert sorted((r.query_id, r.near_id, r["rank"], r.distance) for r in got) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]
    assert collide.similar(df.limit(0), df, "id", list("abcd"), SPREAD).count() == 0
    assert collide.similar(df, df.limit(0), "id", list("abcd"), SPREAD).count() == 0


def test_one_vector_for_all(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0) for i in range(2000)], SCHEMA)
    got = {}
    for r in collide.similar(df, df.filter("id % 500 = 3"), "id", list("abcd"), SPREAD, collide.CollisionSpec(k=3)).collect():
        got.setdefault(r.query_id, []).append(r.near_id)
    assert {q: sorted(n) for q, n in got.items()} == {3: [0, 1, 2], 503: [0, 1, 2], 1003: [0, 1, 2], 1503: [0, 1, 2]}


def test_text_ids(spark):
    df = spark.createDataFrame([(f"r{i}", float(i // 2), 0.0, 0.0, 0.0) for i in range(8)], SCHEMA.replace("id long", "id string"))
    got = collide.similar(df, df, "id", list("abcd"), SPREAD, collide.CollisionSpec(k=1)).collect()
    assert {r.query_id: r.near_id for r in got} == {f"r{i}": f"r{i ^ 1}" for i in range(8)}
