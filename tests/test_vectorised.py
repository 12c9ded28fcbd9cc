"""K-mers and peptides of whole batches against a window at a time."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.constants import AA28, CODON64
from kmerloom.functions import vectorised
from kmerloom.operators.counting import count_kmers

MITOCHONDRIAL = "KNKNTTTT*S*SMIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSSWCWCLFLF"


def by_hand(rows, k, code):
    counts = Counter()
    for sample, seq in rows:
        dna = (seq or "").upper().replace("U", "T")
        if len(dna) < k or set(dna) - set("ACGT"):
            continue
        for s in range(len(dna) - k + 1):
            codons = [dna[i : i + 3] for i in range(s, s + k, 3)]
            peptide = "".join(code["ACGT".index(c[0]) * 16 + "ACGT".index(c[1]) * 4 + "ACGT".index(c[2])] for c in codons)
            if "*" not in peptide:
                counts[sample, peptide] += 1
    return counts


def reads(rng, n):
    rows = [(rng.choice([None, 1, 2, 3]), "".join(rng.choice("ACGTacgtUu") for _ in range(rng.choice([0, 5, 40, 200])))) for _ in range(n)]
    return rows + [(1, None), (1, ""), (2, "ACGN" * 20), (2, "ACGTé" * 20), (3, "A" * 36), *rows[:5]]


@pytest.mark.parametrize("k, segment, code", [(3, 1 << 22, CODON64), (6, 100, CODON64), (21, 1000, MITOCHONDRIAL), (30, 300, CODON64), (36, 1 << 22, CODON64)])
def test_counts(spark, monkeypatch, k, segment, code):
    rows = reads(random.Random(k), 200)
    df = spark.createDataFrame([(s, x, 7, "n") for s, x in rows], "sample_idx int, seq string, kmer_bits int, n string")
    vectorised_rows = list(rows)
    got = {(r.sample_idx, r.kmer): r.cnt for r in count_kmers(df, k, code=code).collect()}
    assert got == by_hand(vectorised_rows, k, code)
    import pyarrow as pa

    monkeypatch.setattr(vectorised, "SEGMENT", segment)
    table, _ = vectorised.genetic_code(code)
    n = k // 3
    counts = Counter()
    for row, key in vectorised.window_keys(pa.array([x for _, x in rows]).slice(3), k, table):
        for r, b in zip(row.tolist(), key.tolist()):
            counts[rows[r + 3][0], "".join(AA28[b >> 5 * (n - 1 - i) & 31] for i in range(n))] += 1
    assert counts == by_hand(rows[3:], k, code)


def test_frames(spark):
    rows = reads(random.Random(5), 60)
    df = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "rec_id int, seq string")
    got = {(r.rec_id, r.frame): r.peptide for r in vectorised.frame_peptides(df, "seq", 9, "rec_id").collect()}
    want = {}
    for i, (_, seq) in enumerate(rows):
        dna = (seq or "").upper().replace("U", "T")
        if len(dna) >= 9 and not set(dna) - set("ACGT"):
            for f in range(3):
                codons = [dna[j : j + 3] for j in range(f, len(dna) - 2, 3)]
                want[i, f] = "".join(CODON64["ACGT".index(c[0]) * 16 + "ACGT".index(c[1]) * 4 + "ACGT".index(c[2])] for c in codons)
    assert got == want


def test_edges(spark):
    empty = spark.createDataFrame([], "sample_idx int, seq string")
    assert count_kmers(empty, 6).count() == 0 and vectorised.frame_peptides(empty, "seq", 6, "sample_idx").count() == 0
    long = spark.createDataFrame([(1, "ACG" * 400_000)], "sample_idx int, seq string").repartition(1)
    assert count_kmers(long, 30).agg(F.sum("cnt")).first()[0] == 1_200_000 - 29
    with pytest.raises(ValueError):
        vectorised.genetic_code("K" * 63)
    with pytest.raises(ValueError):
        vectorised.genetic_code("1" * 64)
