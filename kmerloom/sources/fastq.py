"""FASTQ files as DataFrames, a plain file in as many tasks as it has splits.

A record is four lines and a quality line may start with any symbol, so a record's place follows only
from the number of lines before it. Plain files are therefore read twice by Spark's text scan: first
every split tells how many lines it has, where its first blank line of each remainder modulo four is,
and its outermost lines; from that follow the number of every line and the blank header that ends a
file. Then every split cuts its own lines into records, while the records that span two splits are put
together from the outermost lines. Gzip files are one split each and are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..durable import materialise

SCHEMA = "path string, read_idx bigint, seq string"
#: Lines at either end of a split that may belong to a record of its neighbours.
EDGE = 3
BLANK = " \t\r\v\f"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, block, value)`` in the order of the lines within every split."""
    scan = spark.read.option("lineSep", "\n").text(paths)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a batch by split."""
    block = batch.column(1).to_numpy()
    file = batch.column(0).dictionary_encode()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(block)]):
        if b > a:
            yield (file.dictionary[int(code[a])].as_py(), int(block[a])), batch.column(2).slice(a, b - a)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its lines, its first blank lines by remainder, its outermost lines."""
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("blank", pa.list_(pa.int64())),
        ("edge", pa.list_(pa.struct([("i", pa.int64()), ("line", pa.string())]))),
    ])
    split, n, blank, head, tail = None, 0, [None] * 4, [], []

    def row() -> pa.RecordBatch:
        edge = dict(head) | dict(tail)
        return pa.RecordBatch.from_pylist([{"file": split[0], "block": split[1], "lines": n, "blank": blank, "edge": [{"i": i, "line": x} for i, x in edge.items()]}], schema)

    for batch in batches:
        for key, lines in _runs(batch):
            if key != split:
                if split:
                    yield row()
                split, n, blank, head, tail = key, 0, [None] * 4, [], []
            empty = np.flatnonzero(pc.equal(pc.utf8_trim(lines, BLANK), "").to_numpy(zero_copy_only=False)) + n
            for r in range(4):
                if blank[r] is None and len(hit := empty[empty % 4 == r]):
                    blank[r] = int(hit[0])
            if n < EDGE:
                head += list(enumerate(lines.slice(0, EDGE - n).to_pylist(), n))
            last = lines.slice(max(0, len(lines) - EDGE)).to_pylist()
            tail = (tail + list(enumerate(last, n + len(lines) - len(last))))[-EDGE:]
            n += len(lines)
    if split:
        yield row()


def _check(name: str, first: int, plus: pa.Array) -> None:
    wrong = pc.invert(pc.starts_with(plus, "+"))
    if (at := pc.index(wrong, True).as_py()) >= 0:
        raise ValueError(f"{name}: no '+' line in read {first + at}")


def _reader(names: dict[str, str], starts: dict[tuple[str, int], tuple[int, int]], strict: bool):
    """Cuts the lines of each split into its whole records; ``starts`` has the lines before a split and the reads of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, number, ends = None, pa.array([], pa.string()), 0, 1 << 62

        def unfinished() -> Iterator[pa.RecordBatch]:
            """The last record of a file of one split that ends before the record's fourth line."""
            if split and split not in starts and len(held) and number < ends and held[0].as_py().strip(BLANK):
                name, (_, seq, plus, *_) = names.get(split[0], split[0]), [*held.to_pylist(), "", ""]
                _check(name, number, pa.array([plus]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number]), pa.array([seq.strip(BLANK)])], names=["path", "read_idx", "seq"])

        for batch in batches:
            for key, lines in _runs(batch):
                if key != split:
                    yield from unfinished()
                    before, ends = starts.get(key, (0, 1 << 62))
                    skip = -before % 4
                    split, held, number = key, pa.array([], pa.string()), (before + skip) // 4
                else:
                    skip = to_skip
                to_skip = max(0, skip - len(lines))
                held = pa.concat_arrays([held, lines.slice(skip).cast(pa.string())])
                n = len(held) // 4
                part, held = held.slice(0, 4 * n), held.slice(4 * n)
                keep = min(n, max(0, ends - number))
                at = np.arange(keep) * 4
                if keep:
                    blank = pc.index(pc.equal(pc.utf8_trim(part.take(at), BLANK), ""), True).as_py()
                    if blank >= 0:
                        if strict:
                            raise ValueError(f"{names.get(key[0], key[0])}: blank header after read {number + blank}")
                        ends, keep = number + blank, blank
                        at = at[:keep]
                if keep:
                    name = names.get(key[0], key[0])
                    _check(name, number, part.take(at + 2))
                    seq = pc.utf8_trim(part.take(at + 1), BLANK)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * keep), pa.array(np.arange(number, number + keep)), seq], names=["path", "read_idx", "seq"])
                number += n
        yield from unfinished()

    return run


def _given_names(spark: SparkSession, paths: list[str], everything: bool) -> dict[str, str]:
    """By the name the scan gives a file: the path it was asked for by; of folders and patterns only if ``everything`` is wanted."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    found = {}
    for p in paths:
        jpath = hadoop(p)
        fs = jpath.getFileSystem(conf)
        for status in fs.globStatus(jpath) or []:
            if status.isDirectory():
                held = [x for x in fs.listStatus(status.getPath()) if not x.isDirectory()] if everything else []
            else:
                held = [status] if everything or jpath.getName() == status.getPath().getName() else []
            for x in held:  # a local file is written with one slash or with three
                uri = spark._jvm.org.apache.spark.paths.SparkPath.fromFileStatus(x).urlEncoded()
                found[uri] = found[uri.replace("file:///", "file:/")] = p
    return found


def read_fastq(spark: SparkSession, paths: str | list[str], *, strict: bool = False, as_given: bool = False) -> DataFrame:
    """``(path, read_idx, seq)`` of files, folders, patterns or URIs that Spark can read.

    A blank header line ends a file, or is an error if ``strict``; a missing '+' is an error. ``path`` is the path as it was given where it names one file, or always if
    ``as_given`` (folders without folders in them), else the file's own. A last record
    without its quality line is a record.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = _given_names(spark, paths, as_given)
    lines = _lines(spark, paths)
    splits = materialise(lines.where(~F.lower("file").endswith(".gz")).mapInArrow(_survey, "file string, block bigint, lines bigint, blank array<bigint>, edge array<struct<i: bigint, line: string>>"), "splits")
    order = Window.partitionBy("file").orderBy("block")  # one row per split
    placed = splits.withColumn("before", F.coalesce(F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A line is a header if its number in the file is a multiple of four.
    header = F.get("blank", F.pmod(-F.col("before"), F.lit(4)).cast("int"))
    placed = materialise(placed.withColumn("ends", F.min((header + F.col("before")) / 4).over(Window.partitionBy("file")).cast("bigint")), "splits")
    # One row per split, which the driver holds anyway for its tasks.
    known = placed.select("file", "block", "before", "ends", "lines").collect()
    several = {r.file for r in known if r.block > 0}
    if strict and (bad := [r for r in known if r.file in several and r.ends is not None]):
        raise ValueError(f"{names.get(bad[0].file, bad[0].file)}: blank header after read {bad[0].ends}")
    starts = {(r.file, r.block): (r.before, 1 << 62 if r.ends is None else r.ends) for r in known if r.file in several}
    whole = lines.mapInArrow(_reader(names, starts, strict), SCHEMA)
    if not several:
        return whole
    given = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("file")], F.col("file")) if names else F.col("file")
    line = placed.where(F.col("file").isin(sorted(several))).select("file", "block", "lines", "before", "ends", F.explode("edge").alias("e"))
    number = F.col("before") + F.col("e.i")
    first = 4 * F.expr("(before + e.i) div 4")
    split_over = (first < F.col("before")) | (first + 4 > F.col("before") + F.col("lines"))
    spanning = line.where(split_over & (F.col("ends").isNull() | (number < 4 * F.col("ends")))).select("file", (first / 4).cast("bigint").alias("read_idx"), (number - first).alias("k"), F.col("e.line").alias("line"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    joined = spanning.groupBy("file", "read_idx").agg(at(0).alias("header"), at(1).alias("seq"), at(2).alias("plus"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.coalesce(F.col("plus").startswith("+"), F.lit(False)), F.coalesce(F.btrim("seq", F.lit(BLANK)), F.lit(""))).otherwise(
        F.raise_error(F.concat(given, F.lit(": no '+' line in read "), F.col("read_idx").cast("string")))
    )
    return whole.unionByName(joined.where(F.btrim("header", F.lit(BLANK)) != "").select(given.alias("path"), "read_idx", checked.alias("seq")))
