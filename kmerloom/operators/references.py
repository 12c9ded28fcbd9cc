"""References to records that do not exist.

Keys are read as (prefix, width, number), their trailing digits being the number, which is unique and
keeps the integers of one kind of key in order. The parents' integers are compressed into runs of
contiguous numbers, each with the time at which its last member was there. Every distinct referring
key is then matched as of its number to the run that starts before it: beyond the run's end there is
no such parent, and before the run's time the parent's own time decides.

Numbers are cut into blocks, so that runs and references of one kind of key, which may be nearly all
rows, are sorted by many tasks. References to one key are reduced to the earliest before that, and
only keys that dangle at all meet the referring rows again, salted against hot keys.

Defined results: null and empty keys are no references; a parent without a time, or a withdrawn one,
is none; a reference without a time dangles; equal rows come out once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..durable import materialise

BLOCK = 1 << 16
SALTS = 8
KEY = ["field", "prefix", "width", "number"]
NEVER = "0001-01-01 00:00:00"


def with_number(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with the columns prefix, width and number of ``key``."""
    digits = F.regexp_extract("__key", r"([0-9]{1,18})\z", 1)
    return df.withColumn("__key", key).withColumn("__digits", digits).select(
        *df.columns, F.expr("substring(__key, 1, length(__key) - length(__digits))").alias("prefix"),
        F.length("__digits").alias("width"),
        F.when(F.col("__digits") == "", F.lit(0).cast("long")).otherwise(F.col("__digits").try_cast("long")).alias("number"),
    )


def contiguous_runs(parents: DataFrame) -> DataFrame:
    """Runs of the parents' numbers: (field, prefix, width, block, start, stop, settled)."""
    of = Window.partitionBy("field", "prefix", "width", "block").orderBy("number")
    marked = parents.withColumn("block", F.expr(f"number div {BLOCK}")).withColumn("run", F.col("number") - F.row_number().over(of))
    return marked.groupBy("field", "prefix", "width", "block", "run").agg(
        F.min("number").alias("start"), F.max("number").alias("stop"), F.max("since").alias("settled")
    ).drop("run")


def dangling(parents: DataFrame, references: DataFrame) -> DataFrame:
    """The references without a parent at their time.

    ``parents`` has (field, key, loaded_at), ``references`` has (ref_table, field, key, rec_id,
    loaded_at); the result adds ``reason``: ``missing`` or ``late``.
    """
    parents = with_number(parents.where("key <> '' and loaded_at is not null"), F.col("key"))
    parents = materialise(parents.groupBy(*KEY).agg(F.min("loaded_at").alias("since")), "parents")
    never = F.lit(NEVER).cast(references.schema["loaded_at"].dataType)
    references = references.where("key <> ''").withColumn("asked", F.coalesce("loaded_at", never))
    references = materialise(with_number(references.distinct(), F.col("key")), "references")

    asked = references.groupBy(*KEY).agg(F.min("asked").alias("asked")).withColumn("block", F.expr(f"number div {BLOCK}"))
    runs = contiguous_runs(parents).select("field", "prefix", "width", "block", F.col("start").alias("number"), F.struct("stop", "settled").alias("run"))
    both = runs.withColumn("asked", F.lit(None).cast(asked.schema["asked"].dataType)).unionByName(asked.withColumn("run", F.lit(None).cast(runs.schema["run"].dataType)))
    # A run that starts at a number sorts before a reference to that number.
    as_of = Window.partitionBy("field", "prefix", "width", "block").orderBy("number", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("before", F.last("run", ignorenulls=True).over(as_of)).where("run is null")
    beyond = F.col("before").isNull() | (F.col("number") > F.col("before.stop"))
    met = materialise(met.where(beyond | (F.col("asked") < F.col("before.settled"))).select(*KEY, beyond.alias("beyond")), "met")
    missing = met.where("beyond").select(*KEY, F.lit(None).cast(parents.schema["since"].dataType).alias("since"))
    unsettled = met.where("not beyond").select(*KEY).join(parents, KEY)
    bad = missing.unionByName(unsettled).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    salted = references.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int"))
    return salted.join(bad, [*KEY, "salt"]).where("since is null or since > asked").select(
        "ref_table", F.col("field").alias("ref_field"), "rec_id", "key", "loaded_at",
        F.when(F.col("since").isNull(), "missing").otherwise("late").alias("reason"),
    )


def annotation_parents(gtf: DataFrame) -> DataFrame:
    """Genes and transcripts that are there: (field, key, loaded_at)."""
    live = gtf.where("deleted_at is null and feature in ('gene', 'transcript')")
    field = F.when(F.col("feature") == "gene", "gene_id").otherwise("transcript_id")
    return live.select(field.alias("field"), F.when(F.col("feature") == "gene", F.col("attrs")["gene_id"]).otherwise(F.col("attrs")["transcript_id"]).alias("key"), "loaded_at")


def annotation_references(gtf: DataFrame) -> DataFrame:
    """Genes named by transcripts, and transcripts named by their parts."""
    live = gtf.where("deleted_at is null and feature <> 'gene'")
    gene = F.col("feature") == "transcript"
    return live.select(
        F.lit("gtf_records").alias("ref_table"), F.when(gene, "gene_id").otherwise("transcript_id").alias("field"),
        F.when(gene, F.col("attrs")["gene_id"]).otherwise(F.col("attrs")["transcript_id"]).alias("key"), "rec_id", "loaded_at",
    )


def header_references(fasta: DataFrame) -> DataFrame:
    """Transcripts and genes named by the headers of transcripts."""
    tokens = F.split("header", " ", -1)
    token = F.get(F.filter(F.slice(tokens, 2, 1 << 30), lambda t: t.startswith("gene:")), F.lit(0))
    named = F.array(
        F.struct(F.lit("transcript_id").alias("field"), F.substring_index(F.get(tokens, F.lit(0)), ".", 1).alias("key")),
        F.struct(F.lit("gene_id").alias("field"), F.substring_index(F.substring(token, 6, 1 << 30), ".", 1).alias("key")),
    )
    return fasta.select(F.lit("fasta_records").alias("ref_table"), F.explode(named).alias("x"), "rec_id", "loaded_at").select(
        "ref_table", "x.field", "x.key", "rec_id", "loaded_at"
    )
