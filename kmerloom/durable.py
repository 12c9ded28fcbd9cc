"""Cutting lineage and reading tables.

Intermediate results that are read more than once are written as Parquet into the shared folder
named by ``spark.checkpoint.dir``: every executor reads them from there, so a lost executor costs
no recomputation, and the columnar files are much smaller than a row checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders made for local sessions that name none, by application; the setting itself cannot be set in a running session.
_OWN: dict[str, str] = {}
#: Intermediates written within the open ``intermediates`` blocks, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where a local session names none.

    What a cluster names is taken as it is: a ``file:`` path may well be a mount that all machines share.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        where = _OWN[app]
    return where.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, label: str, suffix: str = "") -> str:
    """A path in the shared folder that is not in use; removed with the open ``intermediates`` block, else see ``remove_at_exit``."""
    path = f"{shared_dir(spark)}/kmerloom/{label}-{uuid.uuid4().hex}{suffix}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder that has been written removed when the application ends."""
    jpath, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(jpath)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Everything written by ``materialise`` within the block is removed at its end; results must have been stored by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            jpath, fs = _hadoop_path(spark, path)
            fs.delete(jpath, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written files.

    The files are removed when the application ends, or with the block of ``intermediates`` they were written in.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan of one driver table, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def unique_rows(df: DataFrame, key: str, *identity: str) -> DataFrame:
    """``df`` with replayed rows (equal in ``identity``, by default in all columns) kept once.

    Only rows whose ``key`` occurs more than once are shuffled whole; the others pass through
    untouched, which matters where rows carry long texts. Rows with a null key are compared too.
    """
    identity = list(identity) or df.columns
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    ids = materialise(ids, "repeated")
    if ids.isEmpty():
        return df
    same = F.col(key).eqNullSafe(F.col("__key"))
    once = df.join(ids, same, "left_anti")
    return once.unionByName(df.join(ids, same, "left_semi").dropDuplicates(identity))


def wide_parallelism(spark: SparkSession) -> int:
    """Partitions for a stage that costs far more than its input's bytes show: no fewer than cores or shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scan: DataFrame) -> DataFrame:
    """A table scan, its rows dealt out anew where it has fewer splits than there are cores.

    For stages bound by computing. A table with a split per core, as any large one, is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
