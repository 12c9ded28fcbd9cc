"""Filling fixed-capacity containers with items of integer size.

Only the histogram of sizes matters for a packing, and it has at most ``capacity`` rows (``GRID`` for a
large capacity) whatever the number of items. So the plan is made from the histogram on the driver and holds for each size ranges
of ranks with the containers they go to; the items themselves are ranked within their size and find
their container by a join with that plan, without ever meeting in one task.

The plan: items above a third of the capacity, of which a container holds at most two, are matched
greedily, the largest first with the largest partner that fits; smaller items then go, largest
first, into the container with the smallest gap they fit in. An item larger than the capacity is cut
into full containers and a remainder, which is packed like any other item.

Defined results: items of null, zero or negative size get no container (NULL); equal sizes are
ordered by key, so the result is the same on every run; repeated keys are separate items; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from ..durable import materialise

#: Items of one size that are ranked by one task at most.
RANK_BLOCK = 500_000
#: Units of a container at most, and rows of a plan that are broadcast at most (about 10 MB).
GRID, PLAN_ROWS = 16_384, 200_000


class Gaps:
    """Open containers by remaining room: gap -> ranges of container numbers."""

    def __init__(self):
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.ranges:
                self.ranges[gap] = []
                bisect.insort(self.sizes, gap)
            self.ranges[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The range with the smallest gap of at least ``least``, removed."""
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[at]
        return gap, first, count


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(size, rank_from, rank_to, first_container, items_per_container)`` rows, and the number of containers.

    The item of ``size`` with rank r (0-based, rank_from <= r < rank_to) goes to container
    first_container + (r - rank_from) // items_per_container.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must be between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps, containers = Gaps(), 0

    def put(size: int, items: int, first: int, per: int) -> None:
        plan.append((size, used[size], used[size] + items, first, per))
        used[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect.bisect_right(large, min(capacity - size, size)) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            partner = large[at] if at >= 0 else None
            if partner == size and left[size] == 1:
                partner = next((s for s in reversed(large[:at]) if left[s]), None)
            if partner is None:
                n = left[size]
                put(size, n, containers, 1)
                gaps.add(capacity - size, containers, n)
            else:
                n = min(left[size], left[partner]) if partner != size else left[size] // 2
                put(size, n, containers, 1)
                put(partner, n, containers, 1)
                gaps.add(capacity - size - partner, containers, n)
            containers += n

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = gaps.take(size)
            if found is None:
                per = capacity // size
                n = -(-left[size] // per)
                found = capacity, containers, n
                containers += n
            gap, first, count = found
            per = min(gap // size, left[size])
            full = min(count, left[size] // per)
            put(size, full * per, first, per)
            gaps.add(gap - per * size, first, full)
            if full < count:
                rest = left[size]
                if rest:  # fewer than fill one more container
                    put(size, rest, first + full, rest)
                    gaps.add(gap - rest * size, first + full, 1)
                    full += 1
                gaps.add(gap, first + full, count - full)
    return plan, containers


def size_unit(capacity: int) -> int:
    """The unit in which sizes are planned: 1, or so much that a container has at most ``GRID`` units."""
    return -(-capacity // GRID)


def pack(df: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``(key, part_no, part_size, container)``: every item, or part of an oversize item, with its container.

    With a capacity above ``GRID`` sizes are rounded up to units for the plan, so no container overflows and the histogram, the
    plan and their broadcast stay as small as for ``GRID`` units; the rounding costs at most a unit per item.
    """
    spark = df.sparkSession
    unit = size_unit(capacity)
    n = F.col("__n")
    parts = df.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__n")).select(
        key, F.explode(F.when(n > capacity, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("__at"), n
    )
    items = parts.select(
        key,
        F.expr(f"__at div {capacity}").cast("int").alias("part_no"),
        F.greatest(F.lit(0).cast("long"), F.least(F.lit(capacity).cast("long"), n - F.col("__at"))).cast("int").alias("part_size"),
    )
    items = materialise(items, "items")
    # An item of more than the whole units of a container has one for itself: it counts as all of them.
    units = capacity // unit
    sized = items.where("part_size > 0").withColumn("__units", F.expr(f"cast(least((part_size + {unit - 1}) div {unit}, {units}) as int)"))
    histogram = {r[0]: r[1] for r in sized.groupBy("__units").count().collect()}  # at most GRID rows
    plan, _ = plan_packing(histogram, units)
    blocks = max(1, -(-max(histogram.values(), default=0) // RANK_BLOCK))
    block = F.pmod(F.xxhash64(key, "part_no"), F.lit(blocks)).cast("int")
    sized = sized.withColumn("__block", block)
    if blocks > 1:
        before = Window.partitionBy("__units").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sized.groupBy("__units", "__block").count().select(
            "__units", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
        )
        sized = sized.join(offsets, ["__units", "__block"])
    else:
        sized = sized.withColumn("__offset", F.lit(0).cast("long"))
    within = Window.partitionBy("__units", "__block").orderBy(key, "part_no")
    ranked = sized.withColumn("__rank", F.row_number().over(within) - 1 + F.col("__offset"))
    # The plan's rows follow from the units of a container, however many items there are; a plan longer than expected is joined by size.
    steps = spark.createDataFrame(plan, "__size int, __from long, __to long, __first long, __per long")
    placed = ranked.join(
        F.broadcast(steps) if len(plan) <= PLAN_ROWS else steps,
        (F.col("__units") == F.col("__size")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    ).select(key, "part_no", "part_size", F.expr("__first + (__rank - __from) div __per").alias("container"))
    return placed.unionByName(items.where("part_size = 0").withColumn("container", F.lit(None).cast("long")))


def packing_checks(packed: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row on a packing: its keys, and how often each of its rules is broken.

    ``overfull`` containers hold more than the capacity, ``homeless`` parts of a size have no container and ``housed`` ones without a
    size have one, ``split`` keys have several parts although they fit one container, ``torn`` keys lack a part or have a part before the last that
    is not full; ``close`` says that the containers are at most 1 % and one above the least possible number.
    """
    fill = packed.where("container is not null").groupBy("container").agg(F.sum("part_size").alias("size"))
    held = fill.agg(F.count_if(F.col("size") > capacity).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    whole = packed.groupBy(key).agg(
        F.count(F.lit(1)).alias("parts"), F.max("part_no").alias("last"), F.sum("part_size").alias("size"), F.count_if(F.col("part_size") == capacity).alias("full"),
        F.count_if(F.col("container").isNull() & (F.col("part_size") > 0)).alias("homeless"), F.count_if(F.col("container").isNotNull() & (F.col("part_size") == 0)).alias("housed"),
    )
    torn = (F.col("parts") != F.col("last") + 1) | (F.col("full") < F.col("parts") - 1)
    keys = whole.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("homeless"), F.lit(0)).alias("homeless"), F.coalesce(F.sum("housed"), F.lit(0)).alias("housed"),
        F.count_if((F.col("parts") > 1) & (F.col("size") <= capacity)).alias("split"), F.count_if(torn).alias("torn"),
    )
    rows = keys.unionByName(held, allowMissingColumns=True)  # two rows
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    close = F.col("containers") <= 1.01 * F.ceil(F.col("tokens") / capacity) + 1
    return one.select("documents", "overfull", "homeless", "housed", "split", "torn", close.alias("close"))


def packing_report(packed: DataFrame, capacity: int, part_size: str = "part_size") -> DataFrame:
    """Containers, tokens, the least possible number of containers and the share of room that is filled."""
    return packed.agg(
        F.countDistinct("container").alias("containers"), F.sum(part_size).alias("tokens")
    ).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"),
    )
