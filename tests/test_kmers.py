"""Reads, translation, windows and packed keys against plain Python."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kmerloom.constants import AA28, CODON64
from kmerloom.functions import kmers
from kmerloom.operators import counting


def translate(dna, code=CODON64):
    at = "ACGT".index
    return "".join(code[16 * at(dna[i]) + 4 * at(dna[i + 1]) + at(dna[i + 2])] for i in range(0, len(dna) - 2, 3))


def brute_counts(reads, k):
    out = {}
    for sample, r in reads:
        if not r or len(r) < k or any(c not in "ACGTUacgtu" for c in r):
            continue
        r = r.upper().replace("U", "T")
        for i in range(len(r) - k + 1):
            aa = translate(r[i : i + k])
            if "*" not in aa:
                out[sample, aa] = out.get((sample, aa), 0) + 1
    return out


def pack(kmer):
    bits = 0
    for c in kmer:
        bits = bits * 32 + AA28.index(c)
    return bits


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    reads = [(rng.randint(1, 3), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 120)))) for _ in range(60)]
    reads += [(1, None), (2, ""), (1, "ACGTN" * 20), (1, "acgu" * 15), (2, "ACGR" * 20), (3, "TAA" * 30), (3, "A" * 5000)]
    for k in (6, 30, 36):
        got = {(r.sample_idx, r.kmer): (r.cnt, r.kmer_bits) for r in counting.count_kmers(spark.createDataFrame(reads, "sample_idx int, seq string"), k).collect()}
        want = {key: (n, pack(key[1])) for key, n in brute_counts(reads, k).items()}
        assert got == want


def test_worked_example(spark):
    reads = [(1, "ATGGCCTTT"), (1, "ATGTAAGCC"), (1, "ATGNCC"), (1, "ATGGC"), (1, "ATGGCC"), (2, "GCCTTT"), (2, "ATGGCC"), (2, "AAAAAA")]
    got = {(r.sample_idx, r.kmer_bits, r.kmer): r.cnt for r in counting.count_kmers(spark.createDataFrame(reads, "sample_idx int, seq string"), 6).collect()}
    assert got == {
        (1, 13, "AF"): 1, (2, 13, "AF"): 1, (1, 139, "CK"): 1, (1, 234, "GL"): 1, (2, 363, "KK"): 1,
        (1, 384, "MA"): 2, (2, 384, "MA"): 1, (1, 558, "WP"): 1, (1, 623, "VS"): 1,
    }


def test_peptide_windows(spark):
    df = spark.createDataFrame([(1, "MAFWP"), (2, "M"), (3, None)], "id int, seq string")
    assert [(r.id, r.kmer) for r in kmers.kmerize_peptide(df, "seq", 2, "id").orderBy("at").collect()] == [(1, "MA"), (1, "AF"), (1, "FW"), (1, "WP")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(AA28, min_size=12, max_size=12), min_size=1, max_size=5))
def test_pack_round_trip(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").withColumn("b", kmers.pack(F.col("w"), 12))
    for r in rows.withColumn("u", kmers.unpack(F.col("b"), 12)).collect():
        assert r.u == r.w and r.b == pack(r.w) and r.b >= 0


def test_pack_refuses(spark):
    rows = spark.createDataFrame([("AC",), ("A#C",), (None,), ("ACDE",), ("ACD",)], "w string").select(kmers.pack(F.col("w"), 3).alias("b"))
    assert [r.b for r in rows.collect()] == [None, None, None, None, 131]
    with pytest.raises(ValueError):
        kmers.pack(F.col("w"), 13)
    for k in (0, 4, 39):
        with pytest.raises(ValueError):
            kmers.residues_of(k)


def test_codes(spark):
    row = spark.range(1).select(
        kmers.twobit(F.lit("G")).alias("g"), kmers.encode5(F.lit("*")).alias("stop"), kmers.encode5(F.lit("#")).alias("none"),
        kmers.decode5(F.lit(28)).alias("far"), kmers.decode5(F.lit(0)).alias("first"), kmers.binary_string(F.lit(131)).alias("bin"),
    ).first()
    assert (row.g, row.stop, row.none, row.far, row.first, row.bin) == (2, 26, None, None, "A", format(131, "064b"))


def test_geometry_of_wide_keys():
    assert kmers.geometry(12, 1) == {"words": 1, "offset": 4, "word": 0, "shift": 55, "straddles": 0}
    assert kmers.geometry(13, 1)["words"] == 2 and kmers.geometry(20, 8)["straddles"] == 1


def test_other_genetic_code(spark):
    code = CODON64.replace("*", "W")
    row = spark.createDataFrame([("TAATAA",)], "s string").select(kmers.translate_frame(F.col("s"), 0, code).alias("p")).first()
    assert row.p == "WW"


def test_read_report(spark):
    rows = [(1, "ACGTACGT"), (1, "ACGTNACGT"), (1, "AC"), (1, None), (1, "ACGTRYACGT")]
    r = counting.read_report(spark.createDataFrame(rows, "sample_idx int, seq string"), 6).first()
    assert (r.reads, r.usable, r.with_n, r.short, r.unencodable) == (5, 1, 1, 2, 1)
