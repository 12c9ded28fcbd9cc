"""Overlaps of more sets than one matrix holds."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from kmerloom.llm import overlap


@pytest.mark.parametrize("kind, name", [("int", lambda s: 3 * s), ("string", lambda s: f"s{s}")])
@pytest.mark.parametrize("tile, light", [(3, 2), (5, 6), (512, 0), (4, 100)])
def test_any_number_of_sets(spark, monkeypatch, kind, name, tile, light):
    """Two full blocks and a part of one; a set of one identifier that no other holds, replayed rows, nulls."""
    monkeypatch.setattr(overlap, "MAX_SETS", 6)
    monkeypatch.setattr(overlap, "TILE", tile)
    monkeypatch.setattr(overlap, "LIGHT", light)
    rng = random.Random(8)
    rows = [(rng.randrange(40), name(rng.randrange(8))) for _ in range(160)] + [(99, name(8)), (None, name(3)), (5, None)]
    rows += [(7, name(s)) for s in range(8)] + rows[:50]
    sets = defaultdict(set)
    for item, s in rows:
        if item is not None and s is not None:
            sets[s].add(item)
    got = {(r.set_a, r.set_b): (r.shared, r.size_a, r.size_b) for r in overlap.overlaps(spark.createDataFrame(rows, f"item bigint, grp {kind}"), "item", "grp").collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
