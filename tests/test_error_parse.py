"""Minimum-cost parsing of raw records."""

import itertools
import re
from datetime import datetime

from hypothesis import given, settings, strategies as st

from kmerloom.operators import error_parse as E

HEAD = "c1\tsrc\texon\t1\t20\t.\t+\t0\t"
RAW = "raw_id bigint, line string, loaded_at timestamp"
T = datetime(2025, 1, 1)

NAME = "[A-Za-z_][A-Za-z0-9_]*"
ITEM = f' *{NAME} +(?:"[^"]*"|[0-9]+) *'


def valid(line):
    f = line.split("\t")
    return (
        len(f) == 9 and all(re.fullmatch("[0-9]{1,18}", f[i]) for i in (3, 4)) and 1 <= int(f[3]) <= int(f[4])
        and f[6] in ("+", "-", ".") and bool(re.fullmatch(f"{ITEM}(?:;{ITEM})*;? *", f[8], re.S))
    )


PIECES = ['gene_id "G1"', 'x "a;b"', "n 3", ";", "; ", " ", '"', "\t", "é", "a", "1", "\r", 'e ""']


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8), st.sampled_from([HEAD, "c\t\t\t0\t5\t\t-\t\t", "c\t\t\t7\t5\t\t.\t\t", ""]))
def test_agrees_with_the_grammar(pieces, head):
    line = head + "".join(pieces)
    assert (E.gtf_reason(line) is None) == valid(line)


def follows(line):
    """Whether a line has the structure, whatever its values."""
    f = line.split("\t")
    item = r' *[^ ;"\t]+ +(?:"[^"\t]*"|[^ ;"\t]+) *'
    return len(f) == 9 and bool(re.fullmatch(f"{item}(?:;{item})*;? *", f[8], re.S))


def test_cost_is_least_on_short_lines():
    """No line with fewer edits than found follows the grammar."""
    for tail in ('a "b', 'a b"', 'a"b"', 'a "b";;c 1', '\ta "b"', 'a "b" c 1'):
        line = HEAD + tail
        cost = len(E.cheapest_edits(line))
        assert cost == 1, (tail, E.cheapest_edits(line))
        once = [line[:i] + line[i + 1 :] for i, c in enumerate(line) if c in '\t;" '] + [line[:i] + c + line[i:] for i, c in itertools.product(range(len(line) + 1), '\t;" ')]
        assert not follows(line) and any(follows(x) for x in once)


def test_reasons_name_the_edit():
    assert E.gtf_reason(HEAD + 'gene_id G1"; x 1') == "delete quote at 34"
    assert E.gtf_reason(HEAD.replace("20", "0") + "gene_id 1") == "field 5 is below 1; field 4 is above field 5"
    assert E.gtf_reason(HEAD + 'gene_id "G1"; level x') == "bare value of 'level' is no number"
    assert E.gtf_reason(None) == "null" and E.gtf_reason("") is not None


def test_load_gtf(spark):
    lines = ["#c", "", " \t", HEAD + 'a "1"; b 2; a "3";', HEAD + 'a "1', HEAD + "a x", None, HEAD.replace("20", "9" * 18) + 'a ""; ', HEAD.replace("20", "9" * 19) + "a 1", HEAD + "a 1\r", "a\tb"]
    df = spark.createDataFrame([(i, x, T) for i, x in enumerate(lines)] * 2, RAW).selectExpr("*", "'x' AS reason", "1 AS f", "2 AS rec_id")
    records, failures = E.load_gtf(df)
    assert {r.rec_id: r.attrs for r in records.collect()} == {3: {"a": "3", "b": "2"}, 7: {"a": ""}}
    rows = failures.collect()
    assert sorted(r.raw_id for r in rows) == [4, 5, 6, 8, 9, 10] and all(r.reason for r in rows)
    assert [x.count() for x in E.load_gtf(df.limit(0))] == [0, 0]


def test_long_lines(spark):
    """Ten thousand items, and a value of a megabyte."""
    many, big = HEAD + ";".join(f'k{i} "v"' for i in range(10_000)), HEAD + f'a "{"x" * 1_000_000}"'
    broken = HEAD + "; ".join(f'k{i} "v"' for i in range(2_000)) + '; k "v'
    df = spark.createDataFrame([(1, many, T), (2, big, T), (3, broken, T)], RAW)
    records, failures = E.load_gtf(df)
    assert {r[0]: r[1] for r in records.selectExpr("rec_id", "size(attrs)").collect()} == {1: 10_000, 2: 1}
    assert [(r.raw_id, r.reason) for r in failures.collect()] == [(3, "insert quote at end")]


def test_load_fasta(spark):
    rows = [">T1 x\nAC\r\n\n gt \n", ">T2\n", ">", "T3\nAC", "> T4\nAC", ">T5\nAC.G", ">T6\nACZ", None, "", ">T7\n\"ACG\"", "\n\n>T8\nACGTNRY", ">T9\nAC\n>T10\nGG", ">T11\n" + "ACGT" * 300_000]
    df = spark.createDataFrame([(i, x, T) for i, x in enumerate(rows)] * 2, "raw_id bigint, record string, loaded_at timestamp").selectExpr("*", "1 AS lines", "2 AS header")
    records, failures = E.load_fasta(df)
    assert {r.rec_id: (r.header, len(r.sequence)) for r in records.distinct().collect()} == {0: ("T1 x", 4), 10: ("T8", 7), 12: ("T11", 1_200_000)}
    got = {r.raw_id: r.reason for r in failures.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    assert got[3] == "insert '>' at line 1" and got[5] == "delete '.' at line 2:3" and got[6] == "symbol 'Z' at line 2:3" and got[11] == "insert record break before line 3"


def test_batches_of_the_programme(monkeypatch):
    """Lines of many lengths at once, in batches of a few, give what each gives alone; the programme's costs are those of a plain one."""
    import random

    rng = random.Random(7)
    lines = [rng.choice([HEAD, "", "c\t1\t"]) + "".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", ""]
    alone = [E.cheapest_edits(x) for x in lines]
    monkeypatch.setattr(E, "BATCH_CELLS", 4000)
    assert E.cheapest_edits_of(lines) == alone

    def least(line):
        cost = {0: 0}
        for c in line:
            kind, step = E.CLASS_OF.get(c, E.OTHER), {}
            for s, v in cost.items():
                for t in range(E.STATES):
                    w = v + int(E.MOVE_COST[kind, s, t])
                    if w < E.FAR and w < step.get(t, E.FAR):
                        step[t] = w
            cost = step
        return min(v + min(int(E.INSERT_COST[s, a]) for a in E.ACCEPTING) for s, v in cost.items())

    price = lambda x: sum(E.MISSING if "name or value" in e else 1 for e in x)
    assert [price(x) for x in alone] == [least(x) for x in lines]
