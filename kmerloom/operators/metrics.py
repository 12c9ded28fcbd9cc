"""Figures about tables and builds."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .positions import key_deltas


def sample_totals(counts: DataFrame) -> DataFrame:
    """Keys and summed counts per sample."""
    return counts.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n_kmers"), F.sum("cnt").alias("total"))


def cardinality_growth(counts: DataFrame) -> DataFrame:
    """``(sample_idx, new_kmers, unique_kmers)``: how many keys a sample adds, and how many there are after it."""
    first = counts.groupBy("kmer_bits").agg(F.min("sample_idx").alias("sample_idx"))
    per = counts.select("sample_idx").distinct().join(first.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n")), "sample_idx", "left")
    upto = Window.orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per sample
    new = F.coalesce("n", F.lit(0).cast("long"))
    return per.select("sample_idx", new.alias("new_kmers"), F.sum(new).over(upto).alias("unique_kmers"))


def elapsed(times: DataFrame, at: str, *order: str) -> DataFrame:
    """Seconds since the row before and since the first row."""
    w = Window.orderBy(*order)  # one row per build
    s = F.col(at).cast("timestamp").cast("double")
    return times.withColumn("since_last", s - F.lag(s).over(w)).withColumn("since_first", s - F.first(s).over(w))


def component_sizes(table) -> DataFrame:
    """Bytes of the columns of a table in wide form, uncompressed."""
    rows = table.wide()
    sums = [F.sum(F.lit(8)).alias("kmer_seq_bytes"), F.count(F.lit(1)).alias("n_kmers")]
    if table.counts is not None:
        sums.append(F.sum(F.size("counts") * 8).alias("count_bytes"))
    if table.masks is not None:
        sums.append(F.sum(F.lit(8)).alias("mask_bytes"))
    return rows.agg(*sums)


#: Keys from one checkpoint to the next in the packed form, bits of a delta, counts of a word and their greatest value (fixed values).
CHECKPOINT_INTERVAL, DELTA_BITS, WORD_COUNTS, MAX_COUNT = 256, 32, 4, 65_535


def packed_sizes(table) -> DataFrame:
    """Keys of a table with counts, and the bytes of the eight parts of its packed form: one row.

    Sorted keys are stored as 32-bit deltas with a checkpoint of 8 bytes at every 256th key and wherever a delta does not fit; a key's
    counts as words of four, up to its last sample, by the 4-byte id of the word and a 2-byte number of them; distinct words
    once, 8 bytes each, with a bit for every count. A greater count is stored as 65,535.
    """
    place, at = (F.col("sample_idx") - 1), F.expr(f"(sample_idx - 1) div {WORD_COUNTS}")
    count = F.least("cnt", F.lit(MAX_COUNT))
    shifted = F.coalesce(*[F.when(place % WORD_COUNTS == i, F.shiftleft(count, 64 // WORD_COUNTS * i)) for i in range(WORD_COUNTS)])
    words = table.counts.select("kmer_bits", at.alias("at"), shifted.alias("c")).groupBy("kmer_bits", "at").agg(F.bit_or("c").alias("word"))
    of_key = words.groupBy("kmer_bits").agg((F.max("at") + 1).alias("words"), F.count(F.lit(1)).alias("held"))
    sums = of_key.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
    distinct = words.groupBy("word").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("d"))
    deltas = key_deltas(table.positions.select("kmer_bits")).join(table.positions, "kmer_bits")
    far = deltas.agg(F.count_if((F.col("delta") >= F.lit(1 << DELTA_BITS)) & ((F.col("pos") - 1) % CHECKPOINT_INTERVAL != 0)).alias("far"))
    rows = sums.unionByName(distinct, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)  # three rows
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    # Words of zeros between a key's first and last are one distinct word more.
    d = F.col("d") + (F.col("words") > F.col("held")).cast("long")
    regular = F.expr(f"(n + {CHECKPOINT_INTERVAL - 1}) div {CHECKPOINT_INTERVAL}")
    return one.select(
        F.col("n").alias("n_kmers"), (8 * (2 * regular + F.col("far")) + 4 * F.col("n")).alias("kmer_seq_bytes"), (8 * (regular + F.col("far"))).alias("checkpoints_bytes"),
        (4 * F.col("n")).alias("deltas_bytes"), (8 * regular).alias("regular_cp_idx_bytes"), (4 * F.col("words")).alias("chunk_ids_bytes"),
        (2 * F.col("n")).alias("n_cids_bytes"), (8 * d).alias("count_words_bytes"), (8 * F.floor((WORD_COUNTS * d + 63) / 64)).alias("bitmap_bytes"),
    )


#: Plots over the samples, and the figures of a run that each shows.
PLOTS = {
    "kmer_cardinality": ("n_kmers",), "query_speed": ("query_time_ms",), "counts_growth": ("count_words_bytes", "bitmap_bytes"),
    "table_growth": ("chunk_ids_bytes", "kmer_seq_bytes", "n_cids_bytes"), "delta_growth": ("checkpoints_bytes", "deltas_bytes", "regular_cp_idx_bytes"),
    "component_sizes": ("kmer_seq_bytes", "chunk_ids_bytes", "n_cids_bytes", "count_words_bytes", "bitmap_bytes"),
}


def plot_rows(history: DataFrame) -> DataFrame:
    """``(plot, series, x, y)`` of recorded runs, one row each with ``samples``, ``timestamp`` and whichever figures there are.

    The sizes of the components are shown for the last run; the time since the run before and since the first in hours.
    """
    # One row per run.
    hours = elapsed(history.select("samples", "timestamp"), "timestamp", "samples").select(
        "samples", (F.col("since_last") / 3600).alias("hours_since_last"), (F.col("since_first") / 3600).alias("hours_since_first")
    )
    runs = history.join(hours, "samples").withColumn("__last", F.max("samples").over(Window.partitionBy()))
    points = []
    for plot, names in {**PLOTS, "elapsed_time": ("hours_since_last", "hours_since_first")}.items():
        for name in names:
            if name in runs.columns:
                there = F.col(name).isNotNull() & ((F.col("samples") == F.col("__last")) | F.lit(plot != "component_sizes"))
                points.append(F.when(there, F.struct(F.lit(plot).alias("plot"), F.lit(name).alias("series"), F.col("samples").cast("double").alias("x"), F.col(name).cast("double").alias("y"))))
    return runs.select(F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())).alias("p")).select("p.*")


def write_plots(rows: DataFrame, folder: str) -> list[str]:
    """One SVG file per plot of ``plot_rows``: bars for the sizes of components, lines for all others."""
    os.makedirs(folder, exist_ok=True)
    plots: dict[str, dict[str, list[tuple[float, float]]]] = {}
    for r in rows.orderBy("plot", "series", "x").collect():  # a point per run and figure
        plots.setdefault(r.plot, {}).setdefault(r.series, []).append((r.x, r.y))
    colours = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd")
    paths = []
    for plot, series in plots.items():
        points = [p for s in series.values() for p in s]
        low, high, top = min(x for x, _ in points), max(x for x, _ in points), max(max(y for _, y in points), 1e-9)
        across = lambda x: 60 + 520 * ((x - low) / (high - low) if high > low else 0.5)
        up = lambda y: 340 - 290 * max(y, 0) / top
        parts = ['<svg xmlns="http://www.w3.org/2000/svg" width="640" height="400" font-family="sans-serif" font-size="12">', f'<text x="60" y="24" font-size="16">{plot}</text>']
        parts += ['<path d="M60 50V340H580" fill="none" stroke="black"/>', f'<text x="4" y="54">{top:.4g}</text><text x="60" y="358">{low:g}</text><text x="560" y="358">{high:g}</text>']
        for i, (name, at) in enumerate(series.items()):
            colour = colours[i % len(colours)]
            if plot == "component_sizes":
                parts += [f'<rect x="{70 + 100 * i}" y="{up(y):.1f}" width="80" height="{340 - up(y):.1f}" fill="{colour}"/>' for _, y in at]
            else:
                parts.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{across(x):.1f},{up(y):.1f}" for x, y in at)}"/>')
                parts += [f'<circle cx="{across(x):.1f}" cy="{up(y):.1f}" r="3" fill="{colour}"/>' for x, y in at]
            parts.append(f'<text x="{60 + 110 * i}" y="380" fill="{colour}">{name}</text>')
        paths.append(os.path.join(folder, f"{plot}.svg"))
        with open(paths[-1], "w") as f:
            f.write("\n".join([*parts, "</svg>"]))
    return paths


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``(layer, files, bytes)`` of the data of a written table; the index of positions is not counted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    layer = F.regexp_extract("path", r"/(counts|masks|wide|keys)/", 1)
    return files.where(layer != "").groupBy(layer.alias("layer")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def load_history(path: str, spark: SparkSession | None = None) -> list[dict]:
    """The recorded runs, none if the file is missing; with a session the path may be of any file system that Spark knows."""
    if spark:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(jpath) else []
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return json.load(f)


def append_history(path: str, entry: dict, spark: SparkSession | None = None) -> list[dict]:
    """The recorded runs with one more, which are written in place of the file; one writer at a time."""
    history = [*load_history(path, spark), entry]
    text = json.dumps(history, indent=2)
    if spark:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        return history
    with open(path, "w") as f:
        f.write(text)
    return history
