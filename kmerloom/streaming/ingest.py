"""Samples that arrive over time.

Every micro-batch writes the rows it brings into a folder of its own; a replayed batch writes the same
rows to the same place, so each counts once. No event time bounds a sample, so the state is the
table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.counting import count_kmers

CHUNK_COUNTS = "kmer_bits bigint, sample_idx int, batch_id bigint, cnt bigint"


def upsert_batch(path: str):
    """A ``foreachBatch`` function that stores the rows of one batch under its id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.where("kmer_bits is not null and sample_idx is not null and cnt > 0").distinct()
        once.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")

    return write


def ingest_counts(stream: DataFrame, path: str, *, checkpoint: str) -> None:
    """Take in all that has arrived of a stream of counts, then return."""
    query = stream.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer_bits, sample_idx, cnt)`` of everything taken in; rows delivered in several batches count once."""
    rows = spark.read.option("basePath", f"{path}/batches").parquet(f"{path}/batches").drop("batch_id").distinct()
    return rows.groupBy("kmer_bits", "sample_idx").agg(F.sum("cnt").alias("cnt"))


def ingest_reads(stream: DataFrame, path: str, k: int, *, checkpoint: str, read_id: str | None = None) -> None:
    """Count the k-mers of reads ``(sample_idx, seq)`` as their files arrive, one folder per batch.

    With ``read_id`` a read that arrives again, in the same batch or a later one, is not counted again: the ids taken in so far are kept
    beside the counts, and a batch is compared with those of the batches before it. Reads without an id are all counted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch
        if read_id:
            named = batch.where(F.col(read_id).isNotNull()).dropDuplicates(["sample_idx", read_id])
            there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
            if batch_id > 0 and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
                earlier = spark.read.option("basePath", f"{path}/ids").parquet(f"{path}/ids").where(F.col("batch_id") < batch_id)  # not those of a first try of this batch
                same = (named["sample_idx"].eqNullSafe(earlier["sample_idx"])) & (named[read_id] == earlier[read_id])
                named = named.join(earlier, same, "left_anti")
            named.select("sample_idx", read_id).write.mode("overwrite").parquet(f"{path}/ids/batch_id={batch_id}")
            new = named.unionByName(batch.where(F.col(read_id).isNull()))
        counted = count_kmers(new, k).select("kmer_bits", "sample_idx", "cnt")
        counted.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested_reads(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all batches of reads, summed."""
    return spark.read.parquet(f"{path}/batches").groupBy("kmer_bits", "sample_idx").agg(F.sum("cnt").alias("cnt"))
