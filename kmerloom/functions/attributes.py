"""Column builders for annotation attributes and transcript headers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def last_wins_map(keys: Column, values: Column) -> Column:
    """Map of two arrays of equal length; of equal keys the last one counts, whatever the session's policy."""
    back, last = F.reverse(keys), F.array_distinct(F.reverse(keys))
    found = F.transform(last, lambda k: F.element_at(F.reverse(values), F.array_position(back, k).cast("int")))
    return F.when(F.size(last) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(last, found))


def gtf_attributes(text: Column) -> Column:
    """Map of the quoted, non-empty attributes of a GTF line; unquoted and empty values are dropped."""
    pattern = F.lit(r'(\w+)\s+"([^"]+)"')
    return last_wins_map(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)))


def gff3_attributes(text: Column) -> Column:
    """Map of the ``key=value`` attributes of a GFF3 line; empty values stay, items without ``=`` are dropped."""
    items = F.filter(F.transform(F.split(text, ";", -1), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    return last_wins_map(F.transform(items, lambda x: F.substring_index(x, "=", 1)), F.transform(items, lambda x: F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)))


def map_text(attrs: Column) -> Column:
    """A map as text, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
