"""The genomic index: which biotypes the transcripts that hold a k-mer have."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import INTERGENIC, MAX_BIOTYPES
from ..functions.biotypes import bit_of, header_biotype, header_transcript, plain_transcript_id
from ..functions.vectorised import grouped_kmers


def transcript_biotypes(records: DataFrame, *, kind: str = "gtf", order: str = "rec_id", strip_version: bool = False) -> DataFrame:
    """``(tid, biotype)`` of the transcripts of annotation records; of several the last by ``order`` counts."""
    a = F.col("attrs")
    if kind == "gtf":
        tid, biotype, features = a["transcript_id"], a["transcript_biotype"], ["transcript"]
    else:
        tid, biotype, features = plain_transcript_id(a["ID"]), a["biotype"], ["transcript", "mRNA"]
    if strip_version:
        tid = F.substring_index(tid, ".", 1)
    rows = records.where(F.col("feature").isin(features)).select(tid.alias("tid"), biotype.alias("biotype"), order).where("tid is not null and biotype is not null")
    return rows.groupBy("tid").agg(F.max_by("biotype", order).alias("biotype"))


def biotype_names(annotation: DataFrame) -> list[str]:
    """Names in the order of their bits: ``intergenic``, then the annotation's biotypes sorted; more than 64 are an error."""
    rows = annotation.select("biotype").where(F.col("biotype") != INTERGENIC).distinct().limit(MAX_BIOTYPES).collect()
    names = [INTERGENIC, *sorted(r[0] for r in rows)]
    if len(names) > MAX_BIOTYPES:
        raise ValueError(f"a mask holds at most {MAX_BIOTYPES} biotypes")
    return names


def resolve_bits(transcripts: DataFrame, annotation: DataFrame, names: list[str]) -> DataFrame:
    """``transcripts`` (header, sequence) with ``bit``: of the header's biotype, else the annotation's, else intergenic.

    A biotype that is not among ``names`` counts as intergenic. The annotation is joined by
    transcript; its size decides between broadcast and shuffle.
    """
    named = transcripts.withColumn("tid", header_transcript(F.col("header"))).join(annotation.withColumnRenamed("biotype", "__annotated"), "tid", "left")
    biotype = F.coalesce(header_biotype(F.col("header")), F.col("__annotated"), F.lit(INTERGENIC))
    position = F.array_position(F.array(*[F.lit(n) for n in names]), biotype)
    return named.withColumn("bit", bit_of(F.nullif(position, F.lit(0)))).drop("tid", "__annotated")


def build_genomic_index(transcripts: DataFrame, annotation: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """``(kmer_bits, biotype_mask)``: the bits of all usable transcripts that hold the k-mer, or-ed."""
    names = names or biotype_names(annotation)
    bits = resolve_bits(transcripts.select("header", "sequence"), annotation, names)
    return grouped_kmers(bits, "sequence", k, "bit").groupBy("kmer_bits").agg(F.bit_or("bit").alias("biotype_mask"))
