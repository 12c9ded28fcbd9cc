"""The k-mer table: construction, pushes, lookups, slices, collapse, biotypes, storage."""

import struct

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import biotypes
from kmerloom.operators import genomic_index, metrics, positions
from kmerloom.operators.table import KmerTable, push_vector, unpack_words
from kmerloom.sources import store

SAMPLE = "kmer_bits bigint, cnt bigint"


def sample(spark, counts):
    return spark.createDataFrame(list(counts.items()), SAMPLE)


@pytest.fixture
def two(spark):
    return KmerTable.from_counts(sample(spark, {100: 3, 200: 5}), 4).push(sample(spark, {200: 2, 500: 7}))


def vectors(table):
    return {r.kmer_bits: r.counts for r in table.wide().collect()}


def test_offsets(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 0, 3, 1])], "i int, n bigint")
    got = [(r.i, r.first) for r in positions.running_offsets(rows, "n", "i").orderBy("i").collect()]
    assert got == [(0, 1), (1, 2), (2, 4), (3, 4), (4, 7)]
    assert positions.running_offsets(rows.limit(0), "n", "i").count() == 0


def test_one_sample(spark):
    t = KmerTable.from_counts(sample(spark, {500: 1, 100: 3, 1000: 9, 200: 7}), 4)
    rows = t.rows().orderBy("pos").collect()
    assert [(r.pos, r.kmer_bits, r.counts) for r in rows] == [(1, 100, [3]), (2, 200, [7]), (3, 500, [1]), (4, 1000, [9])]
    assert t.length() == 4 and t.find(999) == 0 and t.find(500) == 3 and t.find(5000) == 0
    probes = spark.createDataFrame([(999,), (1000,), (1000,), (None,)], "kmer_bits bigint")
    assert sorted((r.kmer_bits or 0, r.pos) for r in t.lookup(probes).collect()) == [(0, 0), (999, 0), (1000, 4), (1000, 4)]


def test_two_samples(spark, two):
    want = {100: [3, 0], 200: [5, 2], 500: [0, 7]}
    assert vectors(two) == want
    wide = push_vector(KmerTable.from_counts(sample(spark, {100: 3, 200: 5}), 4).wide(), sample(spark, {200: 2, 500: 7}), 1)
    assert {r.kmer_bits: r.counts for r in wide.collect()} == want


def test_empty_sample_is_a_zero_column(spark, two):
    assert vectors(two.push(sample(spark, {100: 0}).limit(0)))[100] == [3, 0, 0]
    assert KmerTable.empty(spark, 4).length() == 0


def test_slices(two):
    assert [r.kmer_bits for r in two.slice(2, 3).orderBy("pos").collect()] == [200, 500]
    assert [r.kmer_bits for r in two.take([3, 1, 3]).orderBy("ordinal").collect()] == [500, 100, 500]
    assert two.at(1).first().kmer_bits == 100 and two.at(9).count() == 0


def test_collapse(spark):
    t = KmerTable.from_counts(sample(spark, {100: 5, 200: 5}), 4)
    dictionary, refs = t.collapse()
    assert dictionary.count() == 1 and refs.count() == 2
    assert t.shared_vectors().first().n_keys == 2


def test_biotype_bits(spark):
    names = ["intergenic", "protein_coding", "lncRNA"]
    masks = spark.createDataFrame([(1, 1), (2, 6), (3, 1)], "kmer_bits bigint, biotype_mask bigint")
    t = KmerTable.from_masks(masks, 4, names)
    assert {r.kmer_bits: r.names for r in t.biotype_names().collect()} == {1: ["intergenic"], 2: ["protein_coding", "lncRNA"], 3: ["intergenic"]}
    assert [r.kmer_bits for r in t.having("lncRNA").collect()] == [2]
    with pytest.raises(ValueError):
        t.having("none")
    with pytest.raises(ValueError):
        KmerTable.from_masks(masks, 4, ["lncRNA"])
    assert [(r.mask_id, r.biotype_mask, r.n_keys) for r in t.mask_pool().orderBy("mask_id").collect()] == [(1, 1, 2), (2, 6, 1)]
    r = t.intergenic_tally().first()
    assert (r.n_intergenic, r.n_kmers) == (2, 3)


def test_bits_at_the_edges(spark):
    rows = spark.createDataFrame([(1,), (64,), (65,), (None,)], "p int").select("p", biotypes.bit_of(F.col("p")).alias("b"))
    assert [r.b for r in rows.collect()] == [1, -(1 << 63), 0, 1]
    names = [f"n{i}" for i in range(64)]
    row = spark.createDataFrame([(-(1 << 63),)], "m bigint").select(biotypes.mask_names(F.col("m"), names).alias("n"), biotypes.has_biotype(F.col("m"), "n63", names).alias("h")).first()
    assert row.n == ["n63"] and row.h


def test_annotate_worked_example(spark):
    fasta = spark.createDataFrame(
        [("T1.1 x transcript_biotype:protein_coding", "ATGGCCTTT"), ("T2.1 x", "GCCTTT"), ("T3.1 x", "ATGTAAGCC"), ("T4.1 x transcript_biotype:weird", "TGGCCT"), (None, "ATG"), ("T5", None)],
        "header string, sequence string",
    )
    annotation = spark.createDataFrame([("T1", "protein_coding"), ("T2", "lncRNA")], "tid string, biotype string")
    names = genomic_index.biotype_names(annotation)
    assert names == ["intergenic", "lncRNA", "protein_coding"]
    index = KmerTable.from_masks(genomic_index.build_genomic_index(fasta, annotation, 6), 2, names)
    counts = KmerTable.from_counts(sample(spark, dict.fromkeys((13, 139, 234, 363, 384, 558, 623), 1)), 2)
    t = counts.add_biotypes(index)
    assert {r.kmer_bits: r.biotype_mask for r in t.masks.collect()} == {13: 6, 139: 1, 234: 4, 363: 1, 384: 4, 558: 5, 623: 1}
    assert t.intergenic_tally().first().n_intergenic == 3
    later = t.push(sample(spark, {999: 2}))
    assert {r.kmer_bits: r.biotype_mask for r in later.wide().collect()}[999] == 1
    with pytest.raises(ValueError):
        index.push(sample(spark, {1: 1}))


def test_too_many_biotypes(spark):
    rows = spark.createDataFrame([(str(i), f"b{i:03}") for i in range(64)], "tid string, biotype string")
    with pytest.raises(ValueError):
        genomic_index.biotype_names(rows)


def test_last_line_wins(spark):
    rows = [(1, "transcript", {"transcript_id": "T", "transcript_biotype": "a"}), (2, "transcript", {"transcript_id": "T", "transcript_biotype": "b"}), (3, "gene", {"transcript_id": "T", "transcript_biotype": "c"}), (4, "transcript", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, feature string, attrs map<string,string>")
    assert [(r.tid, r.biotype) for r in genomic_index.transcript_biotypes(df).collect()] == [("T", "b")]


@pytest.mark.parametrize("layers", ["none", "counts", "biotype", "both"])
def test_round_trip(spark, tmp_path, layers):
    counts = KmerTable.from_counts(sample(spark, {100: 3, 200: 7, 500: 1}), 4)
    index = KmerTable.from_masks(spark.createDataFrame([(100, 2), (700, 1)], "kmer_bits bigint, biotype_mask bigint"), 4, ["intergenic", "x"])
    t = {"none": KmerTable(4, bare=counts.keys), "counts": counts, "biotype": index, "both": counts.add_biotypes(index)}[layers]
    store.write_table(t, str(tmp_path))
    back = store.load_table(spark, str(tmp_path))
    assert back.layers_mask == t.layers_mask == {"none": 0, "counts": 1, "biotype": 2, "both": 3}[layers]
    assert sorted(map(str, back.wide().collect())) == sorted(map(str, t.wide().collect()))
    meta = store.read_meta(spark, str(tmp_path))
    assert meta["n_kmers"] == t.length() and meta["format_version"] == 3.0


def test_sample_replaces_itself_and_compacts(spark, tmp_path):
    t = KmerTable.from_counts(sample(spark, {100: 3, 200: 7, 1 << 17: 1}), 4)
    store.write_table(t, str(tmp_path))
    for _ in range(2):
        store.write_sample(sample(spark, {100: 5}), str(tmp_path), 1)
    back = store.load_table(spark, str(tmp_path))
    assert vectors(back) == {100: [5]}
    store.compact(t, str(tmp_path))
    assert store.find_key(spark, str(tmp_path), "wide", 200, 4).first().counts == [7]
    assert store.find_key(spark, str(tmp_path), "wide", 201, 4).count() == 0
    assert {r.layer for r in metrics.stored_bytes(spark, str(tmp_path)).collect()} == {"counts", "wide"}


def test_legacy_version(tmp_path):
    p = tmp_path / "old.bin"
    p.write_bytes(struct.pack("<d", 1.4) + b"rest")
    assert store.legacy_version(str(p)) == 1.4
    p.write_bytes(b"abc")
    with pytest.raises(ValueError):
        store.legacy_version(str(p))


def test_unpack_words(spark):
    word = (1 | 2 << 16 | 3 << 32 | 65535 << 48) - (1 << 64)  # as a signed word
    rows = [([word, 7], 1, 6), ([word, None, 9], 2, 3), (None, None, 2), ([5], 1, 0), ([word, 1], 2, None)]
    df = spark.createDataFrame(rows, "w array<bigint>, n int, s int").select(unpack_words(F.col("w"), F.col("n"), F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == [[1, 2, 3, 65535, 0, 0], [1, 2, 3], [0, 0], [], []]


def test_history(tmp_path):
    p = str(tmp_path / "h.json")
    assert metrics.load_history(p) == []
    metrics.append_history(p, {"samples": 1})
    assert metrics.append_history(p, {"samples": 2}) == metrics.load_history(p) == [{"samples": 1}, {"samples": 2}]


def test_deltas(spark):
    df = spark.createDataFrame([(5,), (1,), (20,), (6,)], "kmer_bits bigint")
    assert [(r.kmer_bits, r.delta) for r in positions.key_deltas(df).orderBy("kmer_bits").collect()] == [(1, None), (5, 4), (6, 1), (20, 14)]


def test_positions_are_stored_and_pruned(spark, tmp_path):
    t = KmerTable.from_counts(sample(spark, {k * 1000: 1 for k in range(1, 300)}), 4)
    assert t.positions is t.positions and t.find_all([1000, 5, 299_000]) == {1000: 1, 5: 0, 299_000: 299}
    assert [r.kmer_bits for r in t.with_prefix(64, 2).orderBy("pos").collect()] == [66000]
    store.write_table(t, str(tmp_path))
    back = store.load_table(spark, str(tmp_path))
    assert back.stored_positions is not None and back.find(7000) == 7 and back.find(7001) == 0
    plan = back.positions.where("kmer_bits = 7000")._jdf.queryExecution().toString()
    assert "EqualTo(kmer_bits,7000)" in plan
    assert back.push(sample(spark, {1: 1})).find(7000) == 8
    store.write_sample(sample(spark, {1: 1}), str(tmp_path), 2)
    assert store.load_table(spark, str(tmp_path)).stored_positions is None


def test_collapse_of_many_keys(spark):
    counts = spark.createDataFrame([(k, s, k % 3 + s) for k in range(60) for s in (1, 2) if (k + s) % 5], "kmer_bits bigint, sample_idx int, cnt bigint")
    t = KmerTable.from_samples(counts, 4, 2)
    want = vectors(t)
    dictionary, refs = t.collapse()
    by_id = {r.vector_id: (r.counts, r.n_keys) for r in dictionary.collect()}
    assert [by_id[i][0] for i in sorted(by_id)] == sorted(map(list, {tuple(v) for v in want.values()}))
    assert {r.kmer_bits: by_id[r.vector_id][0] for r in refs.collect()} == want
    assert {i: n for i, (_, n) in by_id.items()} == {i: sum(v == c for v in want.values()) for i, (c, _) in by_id.items()}
