"""All core queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, integrity, kmer_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**kmer_queries.QUERIES, **file_queries.QUERIES, **integrity.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**kmer_queries.ORACLE, **file_queries.ORACLE, **integrity.ORACLE}
