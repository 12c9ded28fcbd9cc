"""From files to tables: the cohort's counts, the genomic index, and figures about them."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import CODON64
from ..durable import materialise
from ..functions.kmers import residues_of
from ..operators import genomic_index, metrics
from ..operators.counting import count_kmers
from ..operators.table import KmerTable
from ..sources import files, store


def count_files(spark: SparkSession, paths: Sequence[str], k: int = 30, *, first_sample: int = 1, code: str = CODON64) -> DataFrame:
    """``(kmer_bits, sample_idx, cnt)`` of FASTQ files, folders or patterns; the sample is the place in ``paths``.

    Gzip files are one task each, so their reads are spread before they are cut up.
    """
    numbered = spark.createDataFrame([(p, i) for i, p in enumerate(paths, first_sample)], "path string, sample_idx int")
    reads = files.read_fastq(spark, list(paths), as_given=True)
    if any(p.endswith(".gz") for p in paths):
        reads = reads.repartition(spark.sparkContext.defaultParallelism)
    return count_kmers(reads.join(F.broadcast(numbered), "path"), k, code=code).select("kmer_bits", "sample_idx", "cnt")  # one small row per path


def build_kmer_table(
    spark: SparkSession, paths: Sequence[str], k: int = 30, *, save_at: Sequence[int] = (), save_path: str | None = None, code: str = CODON64,
    compact_every: int | None = None, benchmark_every: int | None = None, history: str | None = None,
) -> KmerTable:
    """Table of all samples, counted in one job; a path may be a file, a folder or a pattern.

    ``save_at`` also writes the tables of the first n samples, ``compact_every`` the vectors of every so many first samples as a
    dictionary (``save_path``/collapsed_n=..), and ``benchmark_every`` appends the figures of every so many first samples
    to the JSON file ``history``. A sample without usable reads is one of zeros. ``paths`` is not changed.
    """
    residues = residues_of(k)
    paths = list(paths)
    if any(not 1 <= n <= len(paths) for n in save_at) or (save_path is None and (save_at or compact_every)):
        raise ValueError("save_at needs a save_path and numbers of samples")
    if benchmark_every and history is None:
        raise ValueError("benchmark_every needs a history")
    counts = materialise(count_files(spark, paths, k, code=code), "cohort")
    first = lambda n: KmerTable.from_samples(counts.where(F.col("sample_idx") <= n), residues, n)
    for n in save_at:
        store.write_table(first(n), f"{save_path}/{datetime.now().strftime('%Y%m%d')}_n_samples={n}")
    for n in range(compact_every, len(paths) + 1, compact_every) if compact_every else ():
        dictionary, references = first(n).collapse()
        dictionary.write.mode("overwrite").parquet(f"{save_path}/collapsed_n={n}/dictionary")
        references.write.mode("overwrite").parquet(f"{save_path}/collapsed_n={n}/references")
    for n in range(benchmark_every, len(paths) + 1, benchmark_every) if benchmark_every else ():
        benchmark_table(first(n), history)
    return first(len(paths))


def build_genomic_index(spark: SparkSession, fasta: str, annotation: str, k: int = 30, *, strip_version: bool = False) -> KmerTable:
    """Genomic index of a transcript file and a GTF or GFF3 annotation."""
    biotypes = materialise(files.read_transcript_biotypes(spark, annotation, strip_version=strip_version), "annotation")
    names = genomic_index.biotype_names(biotypes)
    masks = genomic_index.build_genomic_index(files.read_fasta(spark, fasta), biotypes, k, names)
    return KmerTable.from_masks(masks, residues_of(k), names)


def benchmark_table(table: KmerTable, history: str, *, probes: int = 100_000, seed: int = 1) -> dict:
    """Measure a table with counts and append the figures to a JSON history: its samples, the time, its keys, the bytes of the eight parts of
    its packed form, and the time of a batch of lookups that all hit."""
    sizes = metrics.packed_sizes(table).first().asDict()
    fraction = probes / max(sizes["n_kmers"], 1)
    drawn = materialise(table.positions.select("kmer_bits").sample(withReplacement=True, fraction=fraction, seed=seed), "probes")
    start = time.time()
    hits = table.lookup(drawn).where("pos > 0").count()
    entry = {"samples": table.samples, "timestamp": datetime.now().isoformat(), **sizes, "lookups": hits, "query_time_ms": round(1000 * (time.time() - start))}
    metrics.append_history(history, entry, drawn.sparkSession if "://" in history else None)
    return entry
