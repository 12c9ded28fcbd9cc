"""The hits of the reads' own peptides against sets by hand, and without broadcasts of what windows were cut from."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.constants import CODON64
from kmerloom.functions import kmers, vectorised
from kmerloom.operators import peptides, read_peptides
from kmerloom.plans import kmer_queries

DATA = "/root/testdata/sf0.001"


def by_hand(rows, k):
    n, counts, own = k // 3, defaultdict(Counter), defaultdict(set)
    for rec, sample, seq in rows:
        dna = (seq or "").upper().replace("U", "T")
        if len(dna) < k or set(dna) - set("ACGT"):
            continue
        for f in range(3):
            codons = [dna[j : j + 3] for j in range(f, len(dna) - 2, 3)]
            for i, piece in enumerate("".join(CODON64["ACGT".index(c[0]) * 16 + "ACGT".index(c[1]) * 4 + "ACGT".index(c[2])] for c in codons).split("*")):
                for j in range(len(piece) - n + 1):
                    counts[piece[j : j + n]][sample] += 1
                    own[rec, f, i].add(piece[j : j + n])
    out = []
    for (rec, f, i), mers in own.items():
        hits = defaultdict(list)
        for m in mers:
            for s, c in counts[m].items():
                hits[s].append(c)
        out += [(rec, f, i, s, len(mers), len(c), min(c), sum(c), len(c) / len(mers)) for s, c in hits.items()]
    return sorted(map(repr, out))


def some_reads(rng, repeated):
    text = lambda n: "".join(rng.choice("ACGTacgtUu") for _ in range(n))
    common = text(300)
    rows = [(i, rng.choice([None, 1, 2, 3]), text(rng.choice([0, 5, 29, 30, 31, 100, 700]))) for i in range(60)]
    rows += [(100 + i, rng.choice([1, 2]), text(rng.randrange(40)) + common[rng.randrange(100) :] + text(20)) for i in range(12)]
    rows += [(200, 1, "A" * 90), (201, 2, "GCA" * 40), (202, 2, "GCA" * 40 + "TAA" * 3 + "GCA" * 20), (203, 1, None), (204, 1, common + "N"), (205, 3, common + "é")]
    rows += [(400 + i, rng.choice([None, 1, 2]), rows[i % 4 + 6][2] or common) for i in range(9)]
    if repeated:
        rows += [(400, 3, next(r[2] for r in rows if r[0] == 400)), (None, 3, common)]
        rows += [(7, 3, common), (7, 1, common[3:] + text(50)), (None, 1, text(90)), (None, None, common), (300, 1, text(200)), (300, 2, text(200))]
    return rows


@pytest.mark.parametrize("k, segment, range_bits, spare, repeated", [(30, 1 << 22, 20, 9, False), (30, 500, 6, 9, True), (6, 2000, 8, 9, True), (12, 300, 4, 1, False), (36, 1 << 22, 12, 40, True), (3, 1000, 20, 9, True)])
def test_hits(spark, monkeypatch, k, segment, range_bits, spare, repeated):
    rows = some_reads(random.Random(k + segment), repeated)
    df = spark.createDataFrame(rows, "rec_id bigint, sample_idx int, seq string").repartition(3)
    monkeypatch.setattr(read_peptides, "RANGE_BITS", range_bits)
    monkeypatch.setattr(read_peptides, "SPARE_BITS", spare)
    monkeypatch.setattr(read_peptides, "SEGMENT_BASES", 2 * segment)

    def segments(batches, k=k):  # the workers import the module anew
        vectorised.SEGMENT = segment
        return kept(batches, k)

    kept = read_peptides.usable_segments
    monkeypatch.setattr(read_peptides, "usable_segments", segments)
    assert sorted(repr(tuple(r)) for r in read_peptides.read_peptide_hits(df, k).collect()) == by_hand(rows, k)


def test_no_reads(spark):
    df = spark.createDataFrame([(1, 1, "ACGT"), (2, 1, None)], "rec_id bigint, sample_idx int, seq string")
    assert read_peptides.read_peptide_hits(df, 30).isEmpty() and read_peptides.read_peptide_hits(df.limit(0), 30).isEmpty()


def broadcasts(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line and "__key" not in line]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_windows_are_not_broadcast(spark):
    """The planner takes windows for as many bytes as what they were cut from, which is far too few."""
    assert broadcasts(kmer_queries.peptide_hits(spark, DATA)) == []
    some = kmer_queries.frame_peptides(spark, DATA)
    counts = kmers.kmerize_peptide(some, "seq", 10).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")).withColumn("sample_idx", F.lit(1))
    assert broadcasts(peptides.peptide_hits(some, counts, 10)) == []


def test_equal_reads_are_cut_once(spark, monkeypatch):
    """Ten copies of a read under other keys give no more k-mers to shuffle than one."""
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(2000))
    kept, pieces = read_peptides.materialise, {}
    monkeypatch.setattr(read_peptides, "SPARE_BITS", 40)
    monkeypatch.setattr(read_peptides, "materialise", lambda df, label: pieces.setdefault(label, kept(df, label)))
    rows = [(i, i % 3, text) for i in range(10)]
    df = spark.createDataFrame(rows, "rec_id bigint, sample_idx int, seq string")
    assert sorted(repr(tuple(r)) for r in read_peptides.read_peptide_hits(df, 30).collect()) == by_hand(rows, 30)
    assert pieces["pieces"].where("kmer_bits is not null").isEmpty()
