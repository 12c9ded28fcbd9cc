"""References against runs of parents, compared with plain Python."""

import random
from datetime import datetime, timedelta

from kmerloom.operators import references as R

T0 = datetime(2025, 1, 1)


def brute(parents, refs):
    out = set()
    for table, field, key, rec, at in refs:
        if not key:
            continue
        if not any(f == field and k == key and t is not None and at is not None and t <= at for f, k, t in parents):
            out.add((table, field, rec))
    return out


def run(spark, parents, refs):
    p = spark.createDataFrame(parents, "field string, key string, loaded_at timestamp")
    r = spark.createDataFrame(refs, "ref_table string, field string, key string, rec_id bigint, loaded_at timestamp")
    return R.dangling(p, r).collect()


def key(rng):
    n = rng.randint(0, 40)
    return rng.choice([f"G{n:04}", f"G{n}", f"g{n:04}", f"G{n:04}.2", "plain", "", None, f"{n}", f"X{'9' * 17}{n:02}", f"G{65_500 + n}", "é1"])


def test_random(spark):
    rng = random.Random(2)
    when = lambda: rng.choice([None, T0 + timedelta(days=rng.randint(0, 5))])
    for _ in range(3):
        parents = [(rng.choice("ab"), key(rng), when()) for _ in range(150)]
        refs = [(rng.choice("xy"), rng.choice("ab"), key(rng), i, when()) for i in range(300)]
        rows = run(spark, parents, refs + refs[:50])
        assert {(r.ref_table, r.ref_field, r.rec_id) for r in rows} == brute(parents, refs)
        assert len(rows) == len({(r.ref_table, r.ref_field, r.rec_id) for r in rows})


def test_reasons_and_hot_key(spark):
    parents = [("a", "G1", T0 + timedelta(days=2)), ("a", "G2", T0)]
    refs = [("x", "a", "G1", i, T0 + timedelta(days=i % 4)) for i in range(2000)] + [("x", "a", "G3", 9999, T0)]
    rows = {r.rec_id: r.reason for r in run(spark, parents, refs)}
    assert rows.pop(9999) == "missing"
    assert rows == {i: "late" for i in range(2000) if i % 4 < 2}


def test_empty(spark):
    assert run(spark, [], []) == []
    assert [r.reason for r in run(spark, [], [("x", "a", "G", 1, T0)])] == ["missing"]
    assert run(spark, [("a", "G", T0)], []) == []


def test_runs(spark):
    rows = [("a", f"G{n}", T0 + timedelta(days=n)) for n in (1, 2, 3, 7, 8)]
    numbered = R.with_number(spark.createDataFrame(rows, "field string, key string, since timestamp"), R.F.col("key"))
    runs = R.contiguous_runs(numbered).orderBy("start").collect()
    assert [(r.start, r.stop, r.settled) for r in runs] == [(1, 3, T0 + timedelta(days=3)), (7, 8, T0 + timedelta(days=8))]


def test_headers(spark):
    rows = [(1, "T1.2 cdna gene:G1.5 gene:G9", T0), (2, None, T0), (3, "", T0), (4, "gene:G2", T0), (5, "T5  x  gene:", T0)]
    got = {(r.rec_id, r.field): r.key for r in R.header_references(spark.createDataFrame(rows, "rec_id bigint, header string, loaded_at timestamp")).collect()}
    assert got[1, "transcript_id"] == "T1" and got[1, "gene_id"] == "G1" and got[4, "gene_id"] is None and got[4, "transcript_id"] == "gene:G2" and got[5, "gene_id"] == ""
