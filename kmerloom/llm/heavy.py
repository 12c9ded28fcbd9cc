"""Most frequent values by exact refinement of hash prefixes.

The values' 64-bit hashes are cut to a short prefix and the weights summed per prefix: a sum bounds
from above the total of every value behind that prefix, so prefixes below the current lower bound
are dropped and the others are lengthened, until the values themselves are counted. However many
distinct values there are, a level holds at most as many sums as there are retained prefixes times
the fan-out of one step, and the retained ones are few: no more than the total weight over the bound.

The lower bound is a share of all weight, or the kth largest of what is known for certain: the sum
of a prefix that holds one value only, the heaviest single row of any other, and the exact totals of
the heaviest rows' values, which are counted on the way.

The totals are exact. Defined results: rows with a null value, or a weight that is null or not
positive, are ignored; equal totals are ordered by value; an empty table gives no rows; repeated
rows count as often as they occur unless ``identity`` names the columns by which a row is a replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..durable import materialise

LEVELS = (12, 22, 34)
#: Bits of the first prefix beyond those that number the k values sought.
SPARE_BITS = 7
#: Retained prefixes up to this number travel as a literal list, more as a join.
LITERALS = 5_000


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("__item"), 64 - bits)


def _keep(rows: DataFrame, bits: int, prefixes: DataFrame) -> DataFrame:
    """``rows`` behind one of ``prefixes`` (one column ``p`` at ``bits``)."""
    some = [r[0] for r in prefixes.limit(LITERALS + 1).collect()]
    if len(some) <= LITERALS:
        # As text: thousands of literals are parsed faster than they are handed over one by one.
        return rows.where(f"shiftrightunsigned(xxhash64(__item), {64 - bits}) in ({', '.join(map(str, some))})") if some else rows.limit(0)
    return rows.join(prefixes, _prefix(bits) == F.col("p"), "left_semi")


def _sums(rows: DataFrame, bits: int, ranked: bool) -> DataFrame:
    """Total, least and greatest value of every prefix, and weight and value of its heaviest row where a rank is sought."""
    sums = [F.sum("__weight").alias("total"), F.min("__item").alias("low"), F.max("__item").alias("high")]
    if ranked:
        sums += [F.max("__weight").alias("most"), F.max_by("__item", "__weight").alias("heaviest")]
    return rows.groupBy(_prefix(bits).alias("p")).agg(*sums)


def _kth_bound(rows: DataFrame, level: DataFrame, k: int):
    """A number that the kth largest total surely reaches, or None while there are not k values."""
    known = level.select("heaviest", F.when(F.col("low") == F.col("high"), F.col("total")).otherwise(F.col("most")).alias("least"))
    best = known.orderBy(F.desc("least")).limit(k).select("least", "heaviest").collect()
    tops = level.orderBy(F.desc("total")).limit(k).select("heaviest").collect()
    if len(best) < k:
        return None
    named = list({r[-1] for r in best} | {r[0] for r in tops})  # at most 2k values
    counted = rows.where(F.col("__item").isin(named)).groupBy("__item").agg(F.sum("__weight").alias("t"))
    exact = [r[0] for r in counted.orderBy(F.desc("t")).limit(k).select("t").collect()]
    return max(best[-1][0], exact[-1] if len(exact) >= k else best[-1][0])


def _candidates(rows: DataFrame, k: int) -> list:
    """Up to 2k values that are likely of large total: of each Arrow batch those of the largest sums, summed over the batches."""
    kind = rows.schema["__item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            sums = np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights=batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
            top = np.argpartition(sums, -k)[-k:] if len(sums) > k else np.arange(len(sums))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(top)), pa.array(sums[top])], names=["__item", "w"])

    found = rows.select("__item", "__weight").mapInArrow(run, f"__item {kind}, w double")
    return [r[0] for r in found.groupBy("__item").agg(F.sum("w").alias("w")).orderBy(F.desc("w")).limit(2 * k).select("__item").collect()]


def _top_of_replayed(rows: DataFrame, item: str, k: int) -> DataFrame:
    """The ``k`` values of largest total, equal ``rows`` counting once, without removing the replays of all rows.

    Replays only raise a prefix's sum, so sums over all rows are upper bounds still. The lower bound is the kth largest of the exact
    totals of some values; only their rows, and those behind the prefixes retained at last, are made distinct.
    """
    # The first prefixes must be many more than k, or what merely shares a prefix hides the values that do not count.
    longer = max(0, (k - 1).bit_length() + SPARE_BITS - LEVELS[0])
    counted = rows.where(F.col("__item").isin(_candidates(rows, k))).distinct().groupBy("__item").agg(F.sum("__weight").alias("t"))
    exact = [r[0] for r in counted.orderBy(F.desc("t")).limit(k).select("t").collect()]
    bound = exact[-1] if len(exact) == k else 1  # fewer values than k: all that count
    left = rows
    for bits in (min(b + longer, 56) for b in LEVELS):
        level = left.groupBy(_prefix(bits).alias("p")).agg(F.sum("__weight").alias("total"))
        kept = materialise(level.where(F.col("total") >= F.lit(bound)), "prefixes")
        left = _keep(left, bits, kept.select("p"))
        if kept.limit(4 * k + 1).count() <= 4 * k:
            break
    result = left.distinct().groupBy(F.col("__item").alias(item)).agg(F.sum("__weight").alias("total"))
    return result.orderBy(F.desc("total"), item).limit(k)


def most_frequent(
    df: DataFrame, item: str, weight: str | None = None, *, k: int | None = None, share: float | None = None, identity: list[str] | None = None
) -> DataFrame:
    """``(item, total)``: the ``k`` values of largest total, or those with at least ``share`` of all weight.

    With ``identity`` rows that are equal in value, weight and these columns count once.
    """
    if (k is None) == (share is None):
        raise ValueError("give either k or share")
    counted = F.lit(1).cast("long") if weight is None else F.col(weight)
    own = [F.col(c).alias(f"__of{n}") for n, c in enumerate(identity or [])]
    rows = df.select(F.col(item).alias("__item"), counted.alias("__weight"), *own).where("__item is not null and __weight > 0")
    if identity is not None and k is not None:
        return _top_of_replayed(rows, item, k)
    if identity is not None:  # a share needs the weight of all rows that count
        rows = rows.distinct().select("__item", "__weight")
    left, bound = rows, None
    for n, bits in enumerate(LEVELS):
        level = materialise(_sums(left, bits, k is not None), "prefixes")
        if share is not None and bound is None:
            bound = (level.agg(F.sum("total")).first()[0] or 0) * share
        elif share is None:
            now = _kth_bound(rows, level, k)
            bound = max(x for x in (bound, now) if x is not None) if (bound, now) != (None, None) else None
        kept = level if bound is None else level.where(F.col("total") >= F.lit(bound))
        if kept.where("low <> high").isEmpty():  # every prefix left holds one value: its sum is the total
            result = kept.select(F.col("low").alias(item), "total")
            break
        left = _keep(left, bits, kept.select("p"))
    else:
        result = left.groupBy(F.col("__item").alias(item)).agg(F.sum("__weight").alias("total"))
        if bound is not None:
            result = result.where(F.col("total") >= F.lit(bound))
    return result if k is None else result.orderBy(F.desc("total"), item).limit(k)
