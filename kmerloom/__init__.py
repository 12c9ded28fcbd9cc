"""Peptide k-mer analytics on Spark DataFrames.

The names below are imported on first use, so that a Python worker that needs one operator does not
import them all.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOME = {
    "operators.counting": ("count_kmers", "merge_counts", "read_report"),
    "operators.error_parse": ("load_fasta", "load_gtf"),
    "operators.genomic_index": ("biotype_names", "transcript_biotypes"),
    "operators.peptides": ("peptide_hits",),
    "operators.references": ("dangling",),
    "operators.table": ("KmerTable",),
    "plans.pipelines": ("benchmark_table", "build_genomic_index", "build_kmer_table"),
    "sources.files": ("read_bio", "read_fasta", "read_fastq", "read_gff3", "read_gtf", "read_mzid", "read_transcript_biotypes"),
    "sources.legacy": ("read_legacy",),
    "sources.store": ("compact", "find_key", "load_table", "read_meta", "write_sample", "write_table"),
}
_WHERE = {name: module for module, names in _HOME.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
