"""Peptides against samples: which samples hold the k-mers of a peptide."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kmers import kmerize_peptide


def peptide_hits(peptides: DataFrame, counts: DataFrame, residues: int, *, key: str = "peptide_id", seq: str = "seq") -> DataFrame:
    """``(key, sample_idx, n_kmers, matched, min_cnt, sum_cnt, coverage)`` from counts ``(kmer, sample_idx, cnt)``.

    ``n_kmers`` counts the distinct k-mers of the peptide, ``coverage`` is the share of them the sample holds.
    """
    parts = kmerize_peptide(peptides, seq, residues, key).select(key, "kmer").distinct()
    sizes = peptides.select(key, F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - (residues - 1)), lambda i: F.substr(F.col(seq), i, F.lit(residues))))).alias("n_kmers")).where(F.length(seq) >= residues)
    # The planner estimates by the bytes before the windows are cut, a fraction of what they take: it must not broadcast them.
    hits = parts.join(counts.hint("merge"), "kmer").groupBy(key, "sample_idx").agg(F.count(F.lit(1)).alias("matched"), F.min("cnt").alias("min_cnt"), F.sum("cnt").alias("sum_cnt"))
    return hits.join(sizes.dropDuplicates([key]).hint("merge"), key).select(key, "sample_idx", "n_kmers", "matched", "min_cnt", "sum_cnt", (F.col("matched") / F.col("n_kmers")).alias("coverage"))
