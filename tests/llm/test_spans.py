"""Shared spans against brute force."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from kmerloom.llm import spans


def brute(rows, n):
    """Pairs, and covered positions by document."""
    held, where = defaultdict(set), defaultdict(list)
    texts = defaultdict(set)
    for key, text in rows:
        if key is not None and text:
            texts[key].add(text)
    for key, all_of in texts.items():
        for text in all_of:
            for i in range(len(text) - n + 1):
                held[text[i : i + n]].add(key)
                where[text[i : i + n]].append((key, i))
    pairs, covered = set(), defaultdict(set)
    for run, keys in held.items():
        if len(keys) > 1:
            pairs |= {(a, b) for a in keys for b in keys if a < b}
            for key, i in where[run]:
                covered[key] |= set(range(i, i + n))
    return pairs, covered


def corpus(rng, docs, alphabet="abcd"):
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += p[a : rng.randint(a, len(p))]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("shard,alphabet", [(spans.SHARD_CLASSES, "abcd"), (1, "abcd"), (2, "aé日😀")])
def test_against_brute_force(spark, shard, alphabet):
    rng = random.Random(shard)
    rows = corpus(rng, 60, alphabet)
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 300), (105, "b" + "a" * 120), (None, rows[5][1]), rows[7]]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, h int, tid int")
    s = spans.SharedSpans(df, 20, anchor=7, shard_classes=shard)
    pairs, covered = brute(rows, 20)
    assert sorted(map(tuple, s.pairs().collect())) == sorted(pairs)
    got = defaultdict(set)
    for r in s.spans().collect():
        span = set(range(r.span_start, r.span_stop))
        assert span and not span & got[r.doc_id]
        got[r.doc_id] |= span
    assert got == covered
    shares = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in s.shares().collect()}
    keys = {k: len(t or "") for k, t in rows if k is not None}
    assert shares == {k: (n, len(covered[k]), len(covered[k]) / n if n else 0.0) for k, n in keys.items()}


def test_empty(spark):
    s = spans.SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), 20, anchor=7)
    assert s.pairs().count() == s.spans().count() == s.shares().count() == 0


def test_very_long_text(spark, monkeypatch):
    """A text in several segments, sharing a run across a border."""
    monkeypatch.setattr(spans, "SEGMENT", 1000)
    monkeypatch.setattr(spans, "_POWERS", None)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(10_000))
    parts = [(i, "x" * 30 + long[i * 700 + 5 : i * 700 + 5 + 60]) for i in range(1, 13)]
    index, pos, h = spans.fingerprint([long, *[t for _, t in parts]], 50, 16)
    by_text = defaultdict(set)
    for i, x in zip(index.tolist(), h.tolist()):
        by_text[i].add(x)
    assert all(by_text[0] & by_text[i] for i in range(1, 13))
    monkeypatch.setattr(spans, "_POWERS", None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=0, max_size=14), st.integers(0, 2), st.integers(0, 1)), min_size=1, max_size=5), st.integers(1, 6))
def test_automaton(rows, n):
    strings, owners = [s for s, _, _ in rows], [(a, a + more) for _, a, more in rows]
    got, sets = spans.shared_in_shard(strings, n, owners)
    texts = lambda m: {x for k, o in enumerate(owners) if m >> k & 1 for x in o}
    holders = defaultdict(int)
    for k, s in enumerate(strings):
        for i in range(len(s) - n + 1):
            holders[s[i : i + n]] |= 1 << k
    several = {m for m in holders.values() if len(texts(m)) > 1}
    assert set(sets) == several
    for s, own in zip(strings, got):
        covered = {p for i in range(len(s) - n + 1) if len(texts(holders[s[i : i + n]])) > 1 for p in range(i, i + n)}
        assert {p for a, b in own for p in range(a, b)} == covered


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=30, max_size=80), st.text("ab", max_size=20), st.text("ab", max_size=20))
def test_common_runs_share_an_anchor(run, left, right):
    index, _, h = spans.fingerprint([run, left + run + right], 30, 9)
    assert set(h[index == 0].tolist()) <= set(h.tolist())
    shared = set(h[index == 0].tolist()) & set(h[index == 1].tolist())
    assert shared


def test_formula_with_ever_different_surroundings(spark):
    """More classes of one anchor than an automaton takes: the anchors are lengthened, and only texts that share more than the formula pair up."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz "
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    formula = noise(150)
    rows = [(i, noise(120) + formula + noise(120)) for i in range(400)]
    tails = [noise(70) for _ in range(3)]
    rows += [(1000 + i, noise(100) + formula + tails[i % 3] + noise(60)) for i in range(30)]
    heads = [noise(49), noise(50)]  # one short of a run of 200, and just enough
    rows += [(2000 + i, noise(90) + heads[i % 2] + formula + noise(90)) for i in range(8)]
    s = spans.SharedSpans(spark.createDataFrame(rows, "doc_id bigint, text string"), 200)
    pairs, covered = brute(rows, 200)
    assert sorted(map(tuple, s.pairs().collect())) == sorted(pairs) and len(pairs) == 3 * 45 + 6
    got = defaultdict(set)
    for r in s.spans().collect():
        got[r.doc_id] |= set(range(r.span_start, r.span_stop))
    assert got == covered
