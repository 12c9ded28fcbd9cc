"""How often every distinct term occurs, and in how many records.

Tokens carry the number of their record and are walked in its order. Every term has a counter of its
occurrences, of its records and of the last record it was seen in; a token counts a record for its
term unless that is the record last seen, so no set of records is ever held. A counter also knows the
first record it saw, which makes two counters of one term into one: the records of both, less one if
the second begins with the record the first ended with.

The walk is made three times by the same rule (``walk``): over the tokens of an Arrow batch, over the
counters of the batches of a task, and, after the one shuffle, which deals counters out by the hash of
their term, in the order of their first record. So a term that is a third of all tokens is one
counter per task when it is shuffled. A task holds at most ``TABLE_TERMS`` counters and hands them on
before it would hold more.

Defined results: null terms, null arrays and entries behind the given length are ignored (their rows
still count as records of the collection); a null or negative length counts as 0; an empty table
gives no terms; repeated rows are separate records here (the queries keep replayed rows once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from ..durable import materialise

TABLE_TERMS = 1_000_000
COUNTER = ["term", "first", "last", "occurrences", "records"]


def walk(terms: pa.Array, first: np.ndarray, last: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One counter per term of counters that come in the order of their records. A token is a counter of one occurrence."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")  # the counters of a term stay in order
    code, first, last = code[order], first[order], last[order]
    new_term = np.ones(len(code), dtype=bool)
    new_term[1:] = code[1:] != code[:-1]
    seen = np.zeros(len(code), dtype=np.int64)
    seen[1:] = ~new_term[1:] & (first[1:] == last[:-1])  # begins with the record last seen
    at = np.flatnonzero(new_term)
    ends = np.append(at[1:], len(code)) - 1
    add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(code[at])), pa.array(first[at]), pa.array(last[ends]), pa.array(add(occurrences[order])), pa.array(add(records[order] - seen))], names=COUNTER,
    )


def task_counters(df: DataFrame, terms: str, length: str | None) -> DataFrame:
    """The counters of each task, and one of a null term whose records are the rows of the task."""
    array: ArrayType = df.schema[terms].dataType
    kind = array.elementType.simpleString()
    used = F.col(terms) if length is None else F.slice(F.col(terms), 1, F.greatest(F.coalesce(F.col(length).cast("int"), F.lit(0)), F.lit(0)))

    def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        term, *numbers = (pa.concat_arrays([b.column(i) for b in held]) for i in range(len(COUNTER)))
        return walk(term, *(x.to_numpy() for x in numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, held = 0, 0, []
        kind_of: pa.DataType | None = None
        for batch in batches:
            lists, number = batch.column(0), batch.column(1).to_numpy()
            kind_of = lists.type.value_type
            total += len(lists)
            flat, parent = lists.flatten(), pc.list_parent_indices(lists)
            there = flat.is_valid()
            flat, parent = flat.filter(there), parent.filter(there)
            if len(flat):
                record, one = number[parent.to_numpy(zero_copy_only=False)], np.ones(len(flat), np.int64)
                held.append(walk(flat, record, record, one, one))
                size += len(held[-1])
            if size > TABLE_TERMS:
                held = [merged(held)]
                size = len(held[0])
                if size > TABLE_TERMS // 2:  # hand the counters on rather than let the table grow
                    yield held[0]
                    held, size = [], 0
        if held:
            yield merged(held)
        if total:
            number = lambda n: pa.array([n], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind_of), number(0), number(0), number(0), number(total)], names=COUNTER)

    numbered = df.select(used.alias("t"), F.monotonically_increasing_id().alias("record"))
    return numbered.mapInArrow(run, f"term {kind}, first bigint, last bigint, occurrences bigint, records bigint")


def term_frequencies(df: DataFrame, terms: str, length: str | None = None, *, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """``(term, occurrences, records, mark)``; mark is ``rare``, ``common`` or null.

    A term is rare if fewer than ``rare_below`` records hold it, else common if at least
    ``common_share`` of all records do.
    """
    by_record = Window.partitionBy("term").orderBy("first", "last")  # of a term at most some counters a task
    seen = F.coalesce((F.lag("last").over(by_record) == F.col("first")).cast("long"), F.lit(0))
    seen = F.when(F.col("term").isNull(), F.lit(0)).otherwise(seen)  # the row counts of the tasks
    walked = task_counters(df, terms, length).withColumn("seen", seen)
    counts = walked.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.col("records") - F.col("seen")).alias("records"))
    counts = materialise(counts, "terms")
    total = counts.where("term is null").select("records").first()
    least = (total[0] if total else 0) * common_share
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") >= F.lit(least), "common")
    return counts.where("term is not null").withColumn("mark", mark)
