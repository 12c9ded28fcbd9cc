"""Overlaps, most frequent values and term frequencies against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from kmerloom.llm import frequency, heavy, overlap


def sets_of(rows):
    sets = defaultdict(set)
    for item, s in rows:
        if item is not None and s is not None:
            sets[s].add(item)
    return sets


@pytest.mark.parametrize("n_sets", [5, 70])
def test_overlaps(spark, n_sets):
    rng = random.Random(n_sets)
    rows = [(rng.choice([None, *range(200)]), rng.choice([None, *range(0, 3 * n_sets, 3)])) for _ in range(3000)]
    rows += [(7, s) for s in range(0, 3 * n_sets, 3)] + rows[:100]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "item bigint, grp int, a int, n int")
    got = {(r.set_a, r.set_b): (r.shared, r.size_a, r.size_b) for r in overlap.overlaps(df, "item", "grp").collect()}
    sets = sets_of(rows)
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}


def test_overlaps_by_name_and_empty(spark):
    rows = [("k1", "b"), ("k1", "a"), ("k2", "b"), (None, "a"), ("k3", None)]
    got = overlap.overlaps(spark.createDataFrame(rows, "item string, grp string"), "item", "grp").collect()
    assert [tuple(r) for r in got] == [("a", "b", 1, 1, 2)]
    assert overlap.overlaps(spark.createDataFrame([], "item string, grp string"), "item", "grp").count() == 0


def test_pair_counts_beyond_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MAX_SETS", 2)
    got = overlap.pair_counts(spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 3)], "item int, grp int"), "item", "grp").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 2, 1), (2, 3, 1), (3, 3, 2)]


def totals_of(rows):
    out = Counter()
    for item, w in rows:
        if item is not None and w is not None and w > 0:
            out[item] += w
    return out


@pytest.mark.parametrize("levels", [heavy.LEVELS, (2, 4), (1,)])
def test_most_frequent(spark, monkeypatch, levels):
    monkeypatch.setattr(heavy, "LEVELS", levels)
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, *range(1000)]), rng.choice([None, 0, -1, 1, 2, 5])) for _ in range(4000)] + [(1, 500), (2, 500)]
    df = spark.createDataFrame([(a, b, 3, 4) for a, b in rows], "item bigint, w bigint, p int, total int")
    totals = totals_of(rows)
    for k in (1, 10, 2000):
        got = [tuple(r) for r in heavy.most_frequent(df, "item", "w", k=k).collect()]
        assert got == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:k]
    got = {tuple(r) for r in heavy.most_frequent(df, "item", "w", share=0.01).collect()}
    assert got == {x for x in totals.items() if x[1] >= 0.01 * sum(totals.values())}


def test_most_frequent_many_prefixes(spark, monkeypatch):
    monkeypatch.setattr(heavy, "LITERALS", 3)
    monkeypatch.setattr(heavy, "LEVELS", (4, 8))
    rows = [(f"v{i % 50}",) for i in range(1000)]
    got = heavy.most_frequent(spark.createDataFrame(rows, "item string"), "item", k=5).collect()
    assert [r.total for r in got] == [20] * 5 and [r.item for r in got] == sorted(f"v{i}" for i in range(50))[:5]


def test_most_frequent_empty(spark):
    df = spark.createDataFrame([], "item bigint, w bigint")
    assert heavy.most_frequent(df, "item", "w", k=3).count() == 0
    assert heavy.most_frequent(df, "item", "w", share=0.1).count() == 0
    with pytest.raises(ValueError):
        heavy.most_frequent(df, "item")


@pytest.mark.parametrize("table", [frequency.TABLE_TERMS, 4])
def test_term_frequencies(spark, monkeypatch, table):
    monkeypatch.setattr(frequency, "TABLE_TERMS", table)
    rng = random.Random(table)
    rows = []
    for _ in range(300):
        terms = None if rng.random() < 0.1 else [rng.choice([None, 1, 1, 1, *range(40)]) for _ in range(rng.randint(0, 8))]
        rows.append((terms, rng.choice([None, -1, 0, 3, 100])))
    rows.append(([7] * 5000 + [8], 5001))
    occurrences, records = Counter(), Counter()
    for terms, n in rows:
        used = [t for t in (terms or [])[: max(n or 0, 0)] if t is not None]
        occurrences.update(used)
        records.update(set(used))
    df = spark.createDataFrame([(t, n, 1, "x") for t, n in rows], "terms array<bigint>, n int, term int, mark string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequency.term_frequencies(df, "terms", "n", rare_below=4, common_share=0.2).collect()}
    mark = lambda r: "rare" if r < 4 else "common" if r >= 0.2 * len(rows) else None
    assert got == {t: (n, records[t], mark(records[t])) for t, n in occurrences.items()}


def test_term_frequencies_of_words(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a", ""],), ([],), (None,)], "w array<string>")
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_frequencies(df, "w").collect()}
    assert got == {"a": (3, 2), "b": (1, 1), "": (1, 1)}
    assert frequency.term_frequencies(df.limit(0), "w").count() == 0


def test_walk_counts_a_record_once_across_counters():
    """A record whose tokens are spread over several counters is one record."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    tokens = sorted((rng.randrange(30), rng.choice("abc")) for _ in range(200))
    occurrences, records = Counter(t for _, t in tokens), Counter(t for _, t in set(tokens))
    for cut in (1, 7, 200):
        held = []
        for i in range(0, len(tokens), cut):
            some = tokens[i : i + cut]
            record, one = np.array([r for r, _ in some]), np.ones(len(some), np.int64)
            held.append(frequency.walk(pa.array([t for _, t in some]), record, record, one, one))
        term, *numbers = (pa.concat_arrays([b.column(i) for b in held]) for i in range(5))
        got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.walk(term, *(x.to_numpy() for x in numbers)).to_pylist()}
        assert got == {t: (occurrences[t], records[t]) for t in occurrences}


@pytest.mark.parametrize("levels", [heavy.LEVELS, (1, 3)])
def test_top_of_replayed_rows(spark, monkeypatch, levels):
    """A value that is large by its replays only is not among the top."""
    monkeypatch.setattr(heavy, "LEVELS", levels)
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, 0, 1, 2, 9]), rng.randrange(4)) for _ in range(3000)]
    rows += [(400, 30, 1)] * 500 + [(401, 20, i) for i in range(9)] + rows[:700]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "item bigint, w bigint, chunk int, total int")
    totals = totals_of([(a, b) for a, b, _ in set(rows)])
    for k in (1, 5, 1000):
        got = [tuple(r) for r in heavy.most_frequent(df, "item", "w", k=k, identity=["chunk", "total"]).collect()]
        assert got == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:k]
    got = {tuple(r) for r in heavy.most_frequent(df, "item", "w", share=0.01, identity=["chunk", "total"]).collect()}
    assert got == {x for x in totals.items() if x[1] >= 0.01 * sum(totals.values())}
    assert heavy.most_frequent(df.limit(0), "item", "w", k=3, identity=["chunk"]).count() == 0
