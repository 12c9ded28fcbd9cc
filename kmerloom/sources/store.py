"""Tables on disk.

``counts/`` is partitioned by sample, so a sample is added by writing one partition, and written
again by overwriting it; ``wide/`` and ``masks/`` are compacted by key, partitioned by its first
residue and sorted within files, so a lookup prunes partitions and row groups. ``meta/`` holds one JSON
document.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import AA28, BITS_PER_RESIDUE, FORMAT_VERSION, INTERGENIC_MASK
from ..operators.table import KmerTable, count_vector


def _bucket(residues: int):
    return F.shiftright("kmer_bits", BITS_PER_RESIDUE * (residues - 1)).cast("int")


def _write_sorted(df: DataFrame, residues: int, path: str) -> None:
    spread = df.withColumn("first_residue", _bucket(residues)).repartitionByRange("first_residue", "kmer_bits")
    spread.sortWithinPartitions("first_residue", "kmer_bits").write.mode("overwrite").partitionBy("first_residue").parquet(path)


def write_table(table: KmerTable, path: str) -> None:
    """Write all layers a table has."""
    spark = (table.counts if table.counts is not None else table.keys).sparkSession
    if table.counts is not None:
        # Range partitions by sample and key: a sample is written by as many tasks as its rows need, each with a range of its keys.
        spread = table.counts.repartitionByRange("sample_idx", "kmer_bits")
        spread.sortWithinPartitions("sample_idx", "kmer_bits").write.mode("overwrite").partitionBy("sample_idx").parquet(f"{path}/counts")
    if table.masks is not None:
        _write_sorted(table.masks, table.residues, f"{path}/masks")
    if not table.layers_mask:
        _write_sorted(table.keys, table.residues, f"{path}/keys")
    _write_sorted(table.positions.select("kmer_bits", "pos"), table.residues, f"{path}/positions")
    _write_meta(spark, path, table)


def _write_meta(spark: SparkSession, path: str, table: KmerTable) -> None:
    meta = {"format_version": FORMAT_VERSION, "residues": table.residues, "alphabet": AA28, "layers_mask": table.layers_mask, "n_kmers": table.length(), "samples": table.samples, "biotypes": table.names, "positions": True}
    _store_meta(spark, path, meta)


def _store_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def load_table(spark: SparkSession, path: str) -> KmerTable:
    meta = read_meta(spark, path)
    if meta["format_version"] > FORMAT_VERSION:
        raise ValueError(f"format {meta['format_version']} is newer than {FORMAT_VERSION}")
    mask = meta["layers_mask"]
    counts = spark.read.schema("kmer_bits bigint, cnt bigint, sample_idx int").parquet(f"{path}/counts").select("kmer_bits", "sample_idx", "cnt") if mask & 1 else None
    masks = spark.read.parquet(f"{path}/masks").select("kmer_bits", "biotype_mask") if mask & 2 else None
    bare = spark.read.parquet(f"{path}/keys").select("kmer_bits") if not mask else None
    placed = spark.read.parquet(f"{path}/positions").select("kmer_bits", "pos") if meta.get("positions") else None
    return KmerTable(meta["residues"], counts, masks, meta["samples"], meta["biotypes"], bare, placed)


def write_sample(sample: DataFrame, path: str, sample_idx: int) -> None:
    """Write the counts ``(kmer_bits, cnt)`` of one sample; the same sample again replaces itself.

    The stored positions no longer hold then and are forgotten: the table places its keys anew when it is asked, or written again.
    """
    spark = sample.sparkSession
    meta = read_meta(spark, path)
    if meta.pop("positions", None):
        _store_meta(spark, path, meta)
    sample.where("cnt > 0").select("kmer_bits", "cnt").write.mode("overwrite").parquet(f"{path}/counts/sample_idx={sample_idx}")


def compact(table: KmerTable, path: str) -> None:
    """Write the wide form, sorted by key."""
    _write_sorted(count_vector(table.counts, table.samples), table.residues, f"{path}/wide")


def find_key(spark: SparkSession, path: str, layer: str, bits: int, residues: int) -> DataFrame:
    """Rows of one key of a compacted layer. Both predicates are given: the scan cannot infer the partition from the key."""
    return spark.read.parquet(f"{path}/{layer}").where((F.col("first_residue") == (bits >> BITS_PER_RESIDUE * (residues - 1))) & (F.col("kmer_bits") == bits)).drop("first_residue")


def legacy_version(path: str) -> float:
    """Version of a native binary file: its first eight bytes, a little-endian double."""
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path} is too short for a table")
    version = struct.unpack("<d", head)[0]
    if version not in (1.0, 1.2, 1.3, 1.4, 2.0, 3.0):
        raise ValueError(f"unknown version {version}")
    return version


def intergenic_default(df: DataFrame) -> DataFrame:
    """Masks with null read as intergenic."""
    return df.fillna({"biotype_mask": INTERGENIC_MASK})
