"""Sizes of the pairwise intersections of many large sets.

One shuffle gathers, for each identifier, the sets that hold it, as a bit per set in as many 64-bit
words as the sets need; the bits are or-ed on the map side first, so an identifier that fills a third
of the rows is a handful of words when it is shuffled. Identifiers then split by their degree: those
in at most ``LIGHT`` sets are expanded to pairs of sets, the others are rows of a dense 0/1 matrix
whose product with its transpose counts all pairs at once. Each task adds both into one small
matrix of sets, and the matrices are summed. No intersection is ever built.

The counts are exact. Defined results: null identifiers and null sets are ignored, repeated rows
count once, sets without identifiers have no row, an empty table gives no rows. One matrix holds at
most ``MAX_SETS`` sets (8 MB in a task); more sets are counted in tiles by the same split of heavy and
light identifiers, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..durable import materialise, wide_parallelism
from ..operators.positions import with_position

LIGHT = 6
#: Sets of one matrix at most, sets of a side of a tile, and tasks over which a tile's identifiers are spread.
MAX_SETS, TILE, TILE_TASKS = 1024, 512, 16
#: Rows of one dense product: float32 counts exactly up to 2**24.
BLOCK_CELLS = 1 << 22


def add_light(into: np.ndarray, bits: np.ndarray, degree: np.ndarray) -> None:
    """Expand the pairs of sets of every row, rows of one degree at a time."""
    n = len(into)
    cells = []
    for d in np.unique(degree):
        at = np.nonzero(bits[degree == d])[1].reshape(-1, d)
        cells += [at[:, i] * n + at[:, j] for i in range(d) for j in range(i, d)]
    if not cells:
        return
    cells = np.concatenate(cells)
    flat = into.reshape(-1)
    if len(flat) <= 4 * len(cells):
        flat += np.bincount(cells, minlength=len(flat))
    else:
        cell, times = np.unique(cells, return_counts=True)
        flat[cell] += times


def add_heavy(into: np.ndarray, bits: np.ndarray) -> None:
    """Add the product of the rows' matrix with its transpose, in blocks; the upper triangle counts."""
    n = len(into)
    step = max(1, min(1 << 24, BLOCK_CELLS // n))
    for start in range(0, len(bits), step):
        x = bits[start : start + step].astype(np.float32)
        into += np.triu(x.T @ x).astype(np.int64)


def _members(df: DataFrame, item: str, member_of: str) -> tuple[DataFrame, list]:
    """``(__item, __set)`` without nulls, and the sets, of which one more than ``MAX_SETS`` at most."""
    rows = df.select(F.col(item).alias("__item"), F.col(member_of).alias("__set")).where("__item is not null and __set is not null")
    return rows, [r[0] for r in rows.select("__set").distinct().limit(MAX_SETS + 1).collect()]


def pair_counts(df: DataFrame, item: str, member_of: str) -> DataFrame:
    """``(set_a, set_b, shared)`` with set_a <= set_b; the pairs of a set with itself hold its size."""
    rows, sets = _members(df, item, member_of)
    return _by_tiles(rows, TILE) if len(sets) > MAX_SETS else _one_matrix(rows, sorted(sets))


def _one_matrix(rows: DataFrame, sets: list) -> DataFrame:
    """``pair_counts`` of rows of at most ``MAX_SETS`` sets."""
    kind = rows.schema["__set"].dataType.simpleString()
    out = f"a {kind}, b {kind}, n bigint"
    if not sets:
        return rows.sparkSession.createDataFrame([], out).toDF("set_a", "set_b", "shared")
    n = len(sets)
    words = -(-n // 64)
    if type(sets[0]) is int and sets[-1] - sets[0] == n - 1:
        rows = rows.select("__item", (F.col("__set") - F.lit(sets[0])).cast("int").alias("__at"))
    else:
        places = rows.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sets)], f"__set {kind}, __at int")
        rows = rows.join(F.broadcast(places), "__set").select("__item", "__at")  # at most MAX_SETS rows
    bit = F.expr("shiftleft(1L, __at % 64)")
    held = [F.bit_or(bit if words == 1 else F.when(F.expr(f"__at div 64 = {w}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    gathered = rows.groupBy("__item").agg(*held).drop("__item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), dtype=np.int64)
        for batch in batches:
            packed = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype("<i8")
            bits = np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little")[:, :n]
            degree = bits.sum(axis=1)
            light = degree <= LIGHT
            add_light(total, bits[light], degree[light])
            add_heavy(total, bits[~light])
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "n"])

    name = F.lit(sets)
    return (
        gathered.mapInArrow(run, "a int, b int, n bigint")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"))
        .select(F.get(name, "a").cast(kind).alias("set_a"), F.get(name, "b").cast(kind).alias("set_b"), "shared")
    )


def _expand_light(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, n)``: how often two places, or a place and itself, come together in one owner; both arrays in order of owner and place."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    degree = np.diff(np.append(begins, len(owner)))
    found = []
    for d in np.unique(degree):
        at = places[begins[degree == d][:, None] + np.arange(d)]
        found += [np.stack([at[:, i], at[:, j]], axis=1) for i in range(d) for j in range(i, d)]
    pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], n


def _by_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``pair_counts`` of any number of sets, in tiles of ``tile`` sets by as many.

    Sets are placed in order and cut into blocks. An identifier's sets are one row of bit words per block it occurs in. Identifiers of few
    sets are expanded to pairs, counted per Arrow batch; those of many give a row for each pair of their blocks, which is shuffled
    to its tile and multiplied there. A tile is spread over several tasks by its identifiers, each with one matrix at a time.
    """
    spark, kind = rows.sparkSession, rows.schema["__set"].dataType.simpleString()
    words = -(-tile // 64)
    names = [f"w{w}" for w in range(words)]
    places = materialise(with_position(rows.select("__set").distinct(), "__set", name="__at").withColumn("__at", F.col("__at") - 1), "places")
    placed = rows.join(places, "__set").select("__item", F.expr(f"__at div {tile}").alias("block"), F.expr(f"cast(__at % {tile} as int)").alias("within"))
    bit = F.expr("shiftleft(1L, within % 64)")
    held = [F.bit_or(F.when(F.expr(f"within div 64 = {w}"), bit).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(names)]
    block = F.struct("block", F.array(*names).alias("words"))
    size = F.sum(sum((F.bit_count(c) for c in names[1:]), F.bit_count(names[0])))
    gathered = placed.groupBy("__item", "block").agg(*held).groupBy("__item").agg(F.sort_array(F.collect_list(block)).alias("blocks"), size.alias("degree"))
    gathered = materialise(gathered.select("blocks", "degree", F.pmod(F.xxhash64("__item"), F.lit(1 << 30)).cast("int").alias("salt")), "gathered")

    def bits_of(words_column: pa.Array) -> np.ndarray:
        packed = words_column.flatten().to_numpy(zero_copy_only=False).reshape(-1, words).astype("<i8")
        return np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little")[:, :tile]

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            at, place = np.nonzero(bits_of(flat.field("words")))
            a, b, n = _expand_light(flat.field("block").to_numpy()[at] * tile + place, owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None

        def counted() -> pa.RecordBatch:
            x, y = np.nonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(x + of[0] * tile), pa.array(y + of[1] * tile), pa.array(total[x, y])], names=["a", "b", "n"])

        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(i)]):
                if hi == lo:
                    continue
                if of != (i[lo], j[lo]):
                    if of:
                        yield counted()
                    of, total = (i[lo], j[lo]), np.zeros((tile, tile), dtype=np.int64)
                x, y = (bits_of(batch.column(c).slice(lo, hi - lo)).astype(np.float32) for c in (2, 3))
                product = (x.T @ y).astype(np.int64)  # at most a batch's rows, which float32 counts exactly
                total += np.triu(product) if of[0] == of[1] else product
        if of:
            yield counted()

    schema = "a bigint, b bigint, n bigint"
    few = gathered.where(F.col("degree") <= LIGHT).select("blocks").mapInArrow(light, schema)
    both = F.flatten(F.transform("blocks", lambda x: F.transform(F.filter("blocks", lambda y: y["block"] >= x["block"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    tiles = gathered.where(F.col("degree") > LIGHT).select(F.explode(both).alias("t"), "salt").select("t.x.block", F.col("t.y.block").alias("other"), F.col("t.x.words"), F.col("t.y.words").alias("others"), "salt")
    parts = wide_parallelism(spark)
    spread = tiles.repartition(parts, "block", "other", F.pmod("salt", F.lit(TILE_TASKS))).sortWithinPartitions("block", "other").drop("salt")
    many = spread.mapInArrow(heavy, schema)
    summed = few.unionByName(many).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    a = places.select(F.col("__at").alias("a"), F.col("__set").cast(kind).alias("set_a"))
    b = places.select(F.col("__at").alias("b"), F.col("__set").cast(kind).alias("set_b"))
    return summed.join(a, "a").join(b, "b").select("set_a", "set_b", "shared")


def overlaps(df: DataFrame, item: str, member_of: str) -> DataFrame:
    """``(set_a, set_b, shared, size_a, size_b)`` with set_a < set_b, for pairs that share anything."""
    rows, sets = _members(df, item, member_of)
    if len(sets) > MAX_SETS:
        pairs, bounded = materialise(_by_tiles(rows, TILE), "pairs"), lambda x: x
    else:
        pairs, bounded = materialise(_one_matrix(rows, sorted(sets)), "pairs"), F.broadcast  # read three times, counted once
    # In one matrix at most MAX_SETS squared rows: one small table, whose sizes are its own diagonal.
    sizes = bounded(pairs.where("set_a = set_b").select(F.col("set_a").alias("__s"), F.col("shared").alias("__n")))
    with_a = pairs.where("set_a < set_b").join(sizes, F.col("set_a") == F.col("__s")).withColumnRenamed("__n", "size_a").drop("__s")
    return with_a.join(sizes, F.col("set_b") == F.col("__s")).withColumnRenamed("__n", "size_b").drop("__s")
