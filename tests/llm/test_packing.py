import random

import pytest

from assay.llm import packing


def packed(spark, sizes, capacities, **spec):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n long").repartition(4)
    return packing.pack(df, "doc_id", "n", capacities, packing.PackSpec(**spec)).collect()


def check(rows, sizes, capacities):
    for name, capacity in capacities.items():
        mine = [r for r in rows if r.spec_id == name]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert max(fill.values(), default=0) <= capacity
        parts = {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.n_tokens))
        assert set(parts) == set(range(len(sizes)))
        for i, size in enumerate(sizes):
            size = max(size or 0, 0)
            own = sorted(parts[i])
            assert sum(p[2] for p in own) == size and (len(own) == 1 or size > capacity)
            assert [p[1] for p in own] == [sum(q[2] for q in own[:k]) for k in range(len(own))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nothing_is_lost_or_split(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, None, -3, 1, 5, 20, 40, 60, 99, 100, 101, 250, 1000]) for _ in range(400)]
    capacities = {"a": 100, "b": 64}
    check(packed(spark, sizes, capacities, windows=5, partition_items=120, merge_items=30), sizes, capacities)


def test_little_space_is_left(spark):
    rng = random.Random(9)
    sizes = [min(2500, int(rng.lognormvariate(6, 1))) for _ in range(6000)]
    rows = check(packed(spark, sizes, {"a": 2048}), sizes, {"a": 2048})
    total = sum(min(s, 10**9) for s in sizes)
    assert len({r.container_id for r in rows}) <= 1.03 * total / 2048 + 2


def test_hot_size(spark):
    sizes = [1025] * 300 + [1023] * 300
    assert len({r.container_id for r in check(packed(spark, sizes, {"a": 2048}), sizes, {"a": 2048})}) == 300


def test_empty_and_all_zero(spark):
    assert packed(spark, [], {"a": 10}) == []
    assert len(check(packed(spark, [0, None, 0], {"a": 10}), [0, None, 0], {"a": 10})) == 3
    with pytest.raises(ValueError):
        packed(spark, [1], {"a": 0})


def test_null_and_large_ids(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, 5), (None, 5), (big + 1, 30)], "doc_id long, n int")
    rows = packing.pack(df, "doc_id", "n", {"a": 20}).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in rows if r.doc_id is not None) == [(False, big, 5), (False, big + 1, 10), (False, big + 1, 20)]
    assert [r.n_tokens for r in rows if r.doc_id is None] == [5]


def test_many_empty_items_share_no_single_container(spark):
    sizes = [0] * 500 + [7] * 20
    rows = check(packed(spark, sizes, {"a": 10}, container_items=30), sizes, {"a": 10})
    held = {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + 1
    assert max(held.values()) <= 30 and len(held) <= 20 + 500 // 25


def test_vocabularies_are_sent_where_the_folder_is_missing(spark, tmp_path):
    from assay.llm import tokens

    tokens.send_vocabulary(spark, "byte_bpe_50k")
    assert tokens.byte_encoding("byte_bpe_50k", str(tmp_path)).encode_ordinary("some words") == tokens.byte_encoding("byte_bpe_50k").encode_ordinary("some words")
