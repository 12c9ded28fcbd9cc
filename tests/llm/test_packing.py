"""Container packing: nothing lost, nothing too full, little room left."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from kmerloom.llm import packing


def check(histogram, capacity):
    plan, n = packing.plan_packing(histogram, capacity)
    fill, seen = Counter(), Counter()
    for size, lo, hi, first, per in plan:
        for r in range(lo, hi):
            fill[first + (r - lo) // per] += size
            seen[size, r] += 1
    assert seen == Counter({(s, r): 1 for s, c in histogram.items() for r in range(c)})
    assert all(v <= capacity for v in fill.values()) and sorted(fill) == list(range(n))
    return n, fill


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 30)))))
def test_plan(case):
    capacity, histogram = case
    n, fill = check(histogram, capacity)
    total = sum(s * c for s, c in histogram.items())
    # Two containers that are both at most half full would have been one.
    assert n <= 2 * -(-total // capacity) or total == 0


def test_large_items_pair():
    n, _ = check({60: 10, 40: 10, 34: 3}, 100)
    assert n == 12
    assert check({51: 7}, 100)[0] == 7 and check({50: 7}, 100)[0] == 4 and check({33: 7}, 100)[0] == 3
    with pytest.raises(ValueError):
        packing.plan_packing({101: 1}, 100)


def test_million_items_plan_is_small():
    rng = random.Random(1)
    h = Counter(min(2048, int(rng.expovariate(1 / 700)) + 1) for _ in range(200_000))
    plan, n = packing.plan_packing(dict(h), 2048)
    assert len(plan) < 20_000 and n <= 1.001 * sum(s * c for s, c in h.items()) / 2048 + 1


@pytest.mark.parametrize("block", [packing.RANK_BLOCK, 3])
def test_pack(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "RANK_BLOCK", block)
    sizes = [5, 5, 5, 5, 5, 5, 5, 0, None, 25, 10, 10, 3, 3, 2, 1, 1, 1]
    rows = [(i, s, "c", 9) for i, s in enumerate(sizes)] + [(None, 4, "c", 9), (None, 4, "c", 9), (3, 5, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container string, part_size int")
    got = packing.pack(df, 10).collect()
    fill = Counter()
    for r in got:
        if r.part_size:
            fill[r.container] += r.part_size
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(s or 0 for _, s, _, _ in rows)
    assert len(fill) == -(-sum(fill.values()) // 10)
    assert sorted((r.doc_id, r.container) for r in got if not r.part_size) == [(7, None), (8, None)]
    assert sorted((r.part_no, r.part_size) for r in got if r.doc_id == 9) == [(0, 10), (1, 10), (2, 5)]
    again = packing.pack(df, 10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    r = packing.packing_report(packing.pack(df, 10), 10).first()
    assert r.containers == r.least_containers == len(fill)


@pytest.mark.parametrize("grid", [7, 10, 33])
def test_capacity_beyond_the_grid(spark, monkeypatch, grid):
    """Sizes planned in units: nothing overflows and nothing is lost, whether or not the units divide the capacity."""
    monkeypatch.setattr(packing, "GRID", grid)
    monkeypatch.setattr(packing, "PLAN_ROWS", grid)  # small plans are broadcast, the others joined
    rng = random.Random(grid)
    sizes = [rng.choice([1, 5, 33, 50, 99, 100, 101, 250, rng.randint(1, 100)]) for _ in range(300)] + [0, None]
    got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens int"), 100)
    fill = Counter()
    for r in got.collect():
        if r.part_size:
            fill[r.container] += r.part_size
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(s or 0 for s in sizes) and None not in fill
    r = packing.packing_checks(got, 100).first()
    assert (r.documents, r.overfull, r.homeless, r.housed, r.split, r.torn) == (302, 0, 0, 0, 0, 0)


def test_checks_find_what_is_wrong(spark):
    rows = [(1, 0, 8, 1), (2, 0, 8, 1), (3, 0, 5, None), (4, 0, 0, 7), (5, 0, 3, 2), (5, 1, 3, 3), (6, 1, 10, 4), (7, 0, 10, 5), (7, 1, 2, 6)]
    r = packing.packing_checks(spark.createDataFrame(rows, "doc_id int, part_no int, part_size int, container bigint"), 10).first()
    assert (r.documents, r.overfull, r.homeless, r.housed, r.split, r.torn) == (7, 1, 1, 1, 1, 2)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(df, 10).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0)], df.schema), 10).first().container is None
