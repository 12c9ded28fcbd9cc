"""Counting peptide k-mers of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import CODON64
from ..functions.kmers import residues_of, unencodable_read, unpack, usable_read
from ..functions.vectorised import grouped_kmers


def count_kmers(reads: DataFrame, k: int, *, seq: str = "seq", sample: str = "sample_idx", code: str = CODON64) -> DataFrame:
    """``(sample_idx, kmer_bits, kmer, cnt)``.

    Packed keys are counted per Arrow batch and again before the one shuffle, which carries numbers only;
    a key is written out as text once per group afterwards.
    """
    parts = grouped_kmers(reads, seq, k, sample, code=code)
    counted = parts.groupBy(F.col(sample).alias("sample_idx"), "kmer_bits").agg(F.sum("n").alias("cnt"))
    return counted.select("sample_idx", "kmer_bits", unpack(F.col("kmer_bits"), residues_of(k)).alias("kmer"), "cnt")


def merge_counts(parts: DataFrame) -> DataFrame:
    """Sum of partial counts ``(sample_idx, kmer_bits, cnt)``."""
    return parts.groupBy("sample_idx", "kmer_bits").agg(F.sum("cnt").alias("cnt"))


def read_report(reads: DataFrame, k: int, *, seq: str = "seq", sample: str = "sample_idx") -> DataFrame:
    """Per sample: reads, usable ones, and those dropped for N, length or other symbols."""
    s = F.col(seq)
    return reads.groupBy(sample).agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(usable_read(s, k)).alias("usable"), F.count_if(s.rlike("[Nn]")).alias("with_n"),
        F.count_if(F.coalesce(F.length(s), F.lit(0)) < k).alias("short"), F.count_if(unencodable_read(s, k)).alias("unencodable"),
    )
