"""Readers for sequencing, transcript, annotation and peptide files.

``read_bio`` chooses by extension (the last one; of ``.gz`` the one before it, FASTQ if unknown).
All formats are scanned by Spark's own text and XML readers, so whatever Spark can read (files, folders,
patterns, URIs, gzip) can be read here, and a large plain file is read by many tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attributes import gff3_attributes, gtf_attributes
from .fastq import read_fastq

KINDS = {"fastq": "fastq", "fq": "fastq", "mzid": "mzid", "fa": "fasta", "fasta": "fasta", "gtf": "gtf", "gff": "gff3", "gff3": "gff3"}


def kind_of(path: str) -> str:
    """Format of a path by its extension; a ValueError for one that is not known."""
    parts = os.path.basename(path).split(".")
    if parts[-1] == "gz":
        return KINDS.get(parts[-2], "fastq") if len(parts) > 2 else "fastq"
    if len(parts) < 2 or parts[-1] not in KINDS:
        raise ValueError(f"no reader for {path}")
    return KINDS[parts[-1]]


#: White space of a line's ends (fixed value).
SPACE = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INDENTED = re.compile(rf"\n[{SPACE}]+>")


def _fasta_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the pieces between ``\\n>``, which come in the order of their file."""
    file = None
    for batch in batches:
        headers, sequences = [], []
        for path, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
            new = block == 0 and path != file
            file = path
            if new:  # the file's first piece keeps its own '>', or is text before any record
                piece = "\n" + piece
                first, *records = INDENTED.split(piece) if not piece.startswith("\n>") else ["", *INDENTED.split(piece[2:])]
            else:
                records = INDENTED.split(piece)
            for record in records:
                header, *lines = record.split("\n")
                headers.append(header.rstrip(SPACE))
                sequences.append("".join([x.strip(SPACE) for x in lines]))
        yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(sequences, pa.string())], names=["header", "sequence"])


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(header, sequence)``. Text before the first ``>`` is skipped, lines are stripped and joined, blank lines ignored.

    A file is cut at ``\\n>`` by the scan, in as many tasks as it has splits; a line that has blanks before its ``>`` starts a
    record too. One ``>`` only belongs to the mark.
    """
    pieces = spark.read.option("lineSep", "\n>").text(path)
    located = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return located.mapInArrow(_fasta_records, "header string, sequence string")


def _annotation(spark: SparkSession, path: str | list[str], attributes, strict: bool) -> DataFrame:
    f = F.split("value", "\t", -1)
    at = lambda n: F.get("f", F.lit(n - 1))

    def number(n: int):
        parsed = at(n).try_cast("long")
        return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"field {n} is no number: "), F.col("value")))).otherwise(parsed) if strict else parsed

    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.btrim("value") != "")).withColumn("f", f).where(F.size("f") >= 9)
    return rows.select(
        at(1).alias("seqname"), at(3).alias("feature"), number(4).alias("start"), number(5).alias("stop"), at(7).alias("strand"),
        attributes(F.rtrim(at(9), F.lit("\r"))).alias("attrs"),
    )


def read_gtf(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """Annotation records; comments, blank lines and lines of fewer than nine fields are skipped.

    A start or stop that is no number is an error; without ``strict`` it is null. ``load_gtf`` reports such lines instead.
    """
    return _annotation(spark, path, gtf_attributes, strict)


def read_gff3(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """As ``read_gtf`` with GFF3 attributes; an embedded FASTA part has no nine fields and falls away."""
    return _annotation(spark, path, gff3_attributes, strict)


def read_mzid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(seq)``: the text of every ``Seq`` element, the last one included."""
    rows = spark.read.format("xml").option("rowTag", "Seq").option("ignoreNamespace", "true").schema("_VALUE string").load(path)
    return rows.select(F.btrim("_VALUE").alias("seq"))


READERS = {"fastq": read_fastq, "fasta": read_fasta, "gtf": read_gtf, "gff3": read_gff3, "mzid": read_mzid}


def read_bio(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by the path's extension."""
    return READERS[kind_of(path)](spark, path)


def read_transcript_biotypes(spark: SparkSession, path: str, *, strip_version: bool = False) -> DataFrame:
    """``(tid, biotype)`` of a GTF or GFF3 file, the last line of a transcript counting (of several files, by their names); other formats are an error."""
    from ..operators.genomic_index import transcript_biotypes

    kind = kind_of(path)
    if kind not in ("gtf", "gff3"):
        raise ValueError(f"{path} is no annotation file")
    # Files in the order of their names, and within a file by line: ids ascend within a split, and splits with their start.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = READERS[kind](spark, path).withColumn("line_no", place)
    return transcript_biotypes(rows, kind=kind, order="line_no", strip_version=strip_version)
