"""Positions of keys in sorted order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..durable import materialise


def with_position(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """``df`` with the 1-based rank of its rows by ``keys`` (which should be unique).

    Rows are range-partitioned and sorted by many tasks; the ranges' row counts, one per partition,
    give each range its offset.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ordered")
    part = F.shiftrightunsigned("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ordered.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__offset") + 1).drop("__id", "__part", "__offset")


def running_offsets(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """``df`` with ``first``: 1 plus the sum of ``size`` over all rows before, by range partition and partition totals."""
    spread = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "sizes")
    order = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = spread.groupBy("__part").agg(F.sum(size).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    first = F.coalesce(F.sum(size).over(order), F.lit(0)) + F.col("__offset") + 1
    return spread.join(F.broadcast(totals), "__part").withColumn("first", first).drop("__part", "__offset")


def closed_offsets(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """``(i, first)`` for i from 1 to n + 1: where the entries of the ith row begin, and at last where all of them end."""
    placed = materialise(with_position(running_offsets(df, size, *keys), *keys, name="i"), "offsets")
    end = placed.agg((F.count(F.lit(1)) + 1).alias("i"), (F.coalesce(F.sum(size), F.lit(0)) + 1).alias("first"))
    return placed.select("i", "first").unionByName(end)


def offset_sizes(offsets: DataFrame) -> DataFrame:
    """``(i, n)``: the sizes that offsets ``(i, first)``, closed by their last entry, came from; each meets its successor by a join."""
    after = offsets.select((F.col("i") - 1).alias("i"), F.col("first").alias("__next"))
    return offsets.join(after, "i").select("i", (F.col("__next") - F.col("first")).alias("n"))


def key_deltas(df: DataFrame, key: str = "kmer_bits") -> DataFrame:
    """``(key, delta)``: the difference to the key before, by range partition; the first key has a null delta."""
    spread = materialise(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()), "keys")
    last = spread.groupBy("__part").agg(F.max(key).alias("__last"))
    border = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__before"))  # one row per partition
    lag = F.lag(key).over(Window.partitionBy("__part").orderBy(key))
    return spread.join(F.broadcast(border), "__part").select(key, (F.col(key) - F.coalesce(lag, F.col("__before"))).alias("delta"))


def at_positions(df: DataFrame, positions: list[int], pos: str = "pos") -> DataFrame:
    """Rows at the given positions, in their order and as often as they are named: adds ``ordinal``."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), "ordinal long, __pos long")
    return wanted.join(df.where(F.col(pos).isin(sorted(set(positions)))), F.col("__pos") == F.col(pos)).drop("__pos")


def between_positions(df: DataFrame, first: int, last: int, pos: str = "pos") -> DataFrame:
    """Rows at positions ``first`` to ``last``, both included."""
    return df.where(F.col(pos).between(first, last))
