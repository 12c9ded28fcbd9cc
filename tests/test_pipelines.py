"""From files to an annotated table, and older files."""

import struct

import numpy as np
import pytest

from kmerloom.operators import metrics
from kmerloom.plans import pipelines
from kmerloom.sources import legacy, store


def fastq(path, reads):
    path.write_text("".join(f"@r\n{r}\n+\n{'I' * len(r)}\n" for r in reads))
    return str(path)


def test_worked_example(spark, tmp_path):
    paths = [fastq(tmp_path / "a.fastq", ["ATGGCCTTT", "ATGTAAGCC", "ATGNCC", "ATGGC", "ATGGCC"]), fastq(tmp_path / "b.fq", ["GCCTTT", "ATGGCC", "AAAAAA"]), fastq(tmp_path / "c.fq", [])]
    t = pipelines.build_kmer_table(spark, paths, 6, save_at=[1], save_path=str(tmp_path / "out"))
    assert len(paths) == 3 and t.samples == 3
    fasta, gtf = tmp_path / "t.fa", tmp_path / "t.gtf"
    fasta.write_text(">T1.1 x transcript_biotype:protein_coding\nATGG\nCCTTT\n>T2.1 x\nGCCTTT\n>T3.1 x\nATGTAAGCC\n>T4.1 x transcript_biotype:weird\nTGGCCT\n")
    line = '1\ts\ttranscript\t1\t9\t.\t+\t.\ttranscript_id "{}"; transcript_biotype "{}";\n'
    gtf.write_text(line.format("T1", "protein_coding") + line.format("T2", "lncRNA"))
    index = pipelines.build_genomic_index(spark, str(fasta), str(gtf), 6)
    rows = t.add_biotypes(index).rows().orderBy("pos").collect()
    assert [(r.kmer, r.counts, r.biotype_mask) for r in rows] == [
        ("AF", [1, 1, 0], 6), ("CK", [1, 0, 0], 1), ("GL", [1, 0, 0], 4), ("KK", [0, 1, 0], 1), ("MA", [2, 1, 0], 4), ("WP", [1, 0, 0], 5), ("VS", [1, 0, 0], 1),
    ]
    saved = store.load_table(spark, str(next((tmp_path / "out").iterdir())))
    assert saved.samples == 1 and saved.length() == 6
    figures = pipelines.benchmark_table(t, str(tmp_path / "h.json"), probes=50)
    assert figures["n_kmers"] == 7 and figures["samples"] == 3 and figures["lookups"] > 0
    with pytest.raises(ValueError):
        pipelines.build_kmer_table(spark, paths, 6, save_at=[9], save_path="x")


def ints(*x):
    return struct.pack(f"<{len(x)}q", *x)


def name(s):
    return ints(len(s)) + s.encode()


BIO = ints(2) + name("intergenic") + name("x") + ints(2) + np.array([1, 2], "<u8").tobytes() + np.array([1, 2, 2], "<u2").tobytes()
COUNTS = np.array([1, 0, 2], "<u2").tobytes() + np.array([1, 1, 2], "<u4").tobytes() + bytes(2 * 16 + 2 * 8)
KEYS = np.array([5, 9, 70], "<u8").tobytes()
BODY = ints(3, 3, 2, 70, 4, 16)
FILES = {
    3.0: name("A") + b"\3" + ints(3, 8, 4, 256, 1, 1) + bytes(8 + 12 + 8) + ints(4, 3, 2, 70, 16) + COUNTS + BIO,
    2.0: name("A") + BODY + ints(256, 1, 1) + bytes(8 + 12 + 8) + COUNTS + BIO,
    1.4: name("A") + BODY + ints(256, 1, 1) + bytes(8 + 12 + 8) + COUNTS,
    1.3: name("A") + BODY + KEYS + COUNTS,
    1.2: name("A") + BODY + KEYS + np.array([1, 2, 2, 4], "<u4").tobytes() + COUNTS[6:],
    1.0: name("A") + ints(3, 8, 4, 256, 1, 1) + bytes(8 + 12 + 8) + BIO,
}


@pytest.mark.parametrize("version", FILES)
def test_legacy(spark, tmp_path, monkeypatch, version):
    p = tmp_path / "old.bin"
    p.write_bytes(struct.pack("<d", version) + ints(10) + FILES[version])
    t = legacy.read_legacy(str(p))
    assert (t.residues, t.alphabet, t.n_kmers) == (10, "A", 3)
    rows = legacy.legacy_rows(spark, str(p)).orderBy("pos").collect()
    assert [r.kmer_bits for r in rows] == ([5, 9, 70] if version in (1.2, 1.3) else [None] * 3)
    assert [r.n_words for r in rows] == ([None] * 3 if version == 1.0 else [1, 0, 2])
    assert [r.biotype_mask for r in rows] == ([1, 2, 2] if version in (1.0, 2.0, 3.0) else [None] * 3)
    monkeypatch.setattr(legacy, "CHUNK", 2)
    assert [tuple(r) for r in legacy.legacy_rows(spark, str(p)).orderBy("pos").collect()] == [tuple(r) for r in rows]
    if version == 1.0:
        with pytest.raises(ValueError, match="no counts"):
            legacy.legacy_words(spark, str(p))
    else:
        assert [tuple(r) for r in legacy.legacy_words(spark, str(p)).orderBy("pos", "slot").collect()] == [(1, 1, 1), (3, 1, 1), (3, 2, 2)]
    assert t.unreadable == {1.0: ["delta-coded keys"], 1.2: ["packed count words"], 1.3: ["packed count words"]}.get(version, ["delta-coded keys", "packed count words"])
    p.write_bytes(p.read_bytes()[:-1])
    with pytest.raises(ValueError):
        legacy.read_legacy(str(p))


def test_figures_during_a_build(spark, tmp_path):
    """Figures and dictionaries of the first samples, plots from the history, and a sample that is a folder."""
    (tmp_path / "a").mkdir()
    paths = [str(tmp_path / "a"), fastq(tmp_path / "b.fq", ["GCCTTT", "ATGGCC"]), fastq(tmp_path / "c.fq", ["GCCTTT" * 3])]
    fastq(tmp_path / "a" / "1.fq", ["ATGGCCTTT"])
    fastq(tmp_path / "a" / "2.fq", ["ATGGCC"])
    history, out = str(tmp_path / "h.json"), str(tmp_path / "out")
    t = pipelines.build_kmer_table(spark, paths, 6, compact_every=2, save_path=out, benchmark_every=1, history=history)
    assert {r.kmer_bits: r.counts for r in t.wide().collect()}[384] == [2, 1, 0]
    assert spark.read.parquet(f"{out}/collapsed_n=2/references").count() == 4 and spark.read.parquet(f"{out}/collapsed_n=2/dictionary").count() == 3
    runs = metrics.load_history(history)
    assert [r["samples"] for r in runs] == [1, 2, 3] and runs[0]["n_kmers"] == 4
    figures = {"samples", "timestamp", "n_kmers", "kmer_seq_bytes", "checkpoints_bytes", "deltas_bytes", "regular_cp_idx_bytes", "chunk_ids_bytes", "n_cids_bytes", "count_words_bytes", "bitmap_bytes", "query_time_ms"}
    assert figures <= set(runs[0])
    rows = metrics.plot_rows(spark.createDataFrame([{k: r[k] for k in figures} for r in runs]))
    assert {r.plot for r in rows.select("plot").distinct().collect()} == {*metrics.PLOTS, "elapsed_time"}
    assert rows.where("plot = 'component_sizes'").count() == 5
    written = metrics.write_plots(rows, str(tmp_path / "plots"))
    assert len(written) == 7 and all(open(p).read().endswith("</svg>") for p in written)
    with pytest.raises(ValueError):
        pipelines.build_kmer_table(spark, paths, 6, benchmark_every=1)


def test_public_names():
    import kmerloom

    assert all(callable(getattr(kmerloom, n)) for n in kmerloom.__all__)
    with pytest.raises(AttributeError):
        kmerloom.nothing


def test_core_does_not_import_llm():
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "kmerloom")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read())
