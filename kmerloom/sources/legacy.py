"""What older binary tables can tell.

These files hold fixed-width little-endian numbers in sections one after the other. The header gives the
place of every section; the rows are then read in ranges by tasks, so the file must lie where all
executors can open it. All versions give their biotype masks and names, the number of count words per
key and the ids of these words; the keys themselves can be read where they are stored flat (1.2 and
1.3). How keys are coded as deltas, and how counts are packed in words, is specified nowhere public, so
these sections are stepped over; ``LegacyTable.unreadable`` names them. The alphabet's name is only
compared, never evaluated.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import legacy_version

#: Rows that one task reads.
CHUNK = 1_000_000


class _File:
    """Sequential reader of numbers that knows where it is."""

    def __init__(self, path: str):
        self.f = open(path, "rb")
        self.at, self.size = 0, os.path.getsize(path)

    def skip(self, n: int) -> int:
        """Step over ``n`` bytes; the place where they begin."""
        if n < 0 or self.at + n > self.size:
            raise ValueError("the file is shorter than its header says")
        self.at += n
        return self.at - n

    def vector(self, kind: str, n: int) -> np.ndarray:
        dtype = np.dtype(kind)
        self.f.seek(self.skip(n * dtype.itemsize))
        return np.frombuffer(self.f.read(n * dtype.itemsize), dtype)

    def ints(self, n: int) -> list[int]:
        return self.vector("<i8", n).tolist()

    def text(self) -> str:
        return self.vector("u1", self.ints(1)[0]).tobytes().decode()


@dataclass
class LegacyTable:
    path: str
    version: float
    residues: int
    alphabet: str
    n_kmers: int = 0
    samples: int = 0
    n_ids: int = 0
    names: list[str] = field(default_factory=list)
    pool: list[int] = field(default_factory=list)  # the distinct masks
    sections: dict[str, int] = field(default_factory=dict)  # where the numbers of the keys begin
    unreadable: list[str] = field(default_factory=list)


def _biotypes(f: _File, t: LegacyTable) -> None:
    t.names = [f.text() for _ in range(f.ints(1)[0])]
    t.pool = f.vector("<u8", f.ints(1)[0]).view(np.int64).tolist()
    t.sections["mask_id"] = f.skip(2 * t.n_kmers)


def _counts(f: _File, t: LegacyTable, n_ids: int, n_words: int, n_bits: int, width: int) -> None:
    if t.version == 1.2:
        t.sections["offset"] = f.skip(4 * (t.n_kmers + 1))
    else:
        t.sections["n_words"] = f.skip(2 * t.n_kmers)
    t.n_ids = n_ids
    t.sections["word_id"] = f.skip(4 * n_ids)
    f.skip(n_words * width + -(-n_bits // 64) * 8)
    t.unreadable.append("packed count words")


def _deltas(f: _File, t: LegacyTable, wide: int, narrow: int, n_wide: int, n_index: int) -> None:
    f.skip(n_wide * wide + t.n_kmers * narrow + n_index * 8)
    t.unreadable.append("delta-coded keys")


def read_legacy(path: str) -> LegacyTable:
    """The header of a file and the places of its sections; a file shorter than its header says is an error."""
    version = legacy_version(path)
    f = _File(path)
    f.skip(8)
    t = LegacyTable(path, version, f.ints(1)[0], f.text())
    if version in (1.0, 3.0):
        layers = int(f.vector("u1", 1)[0]) if version == 3.0 else 2
        t.n_kmers, wide, narrow, _, n_wide, n_index = f.ints(6)
        _deltas(f, t, wide, narrow, n_wide, n_index)
        if layers & 1:
            t.samples, *sizes = f.ints(5)
            _counts(f, t, *sizes)
        if layers & 2:
            _biotypes(f, t)
        return t
    t.n_kmers, n_ids, n_words, n_bits, t.samples, width = f.ints(6)
    if version in (1.2, 1.3):
        t.sections["key"] = f.skip(8 * t.n_kmers)
    else:
        _, n_wide, n_index = f.ints(3)
        _deltas(f, t, 8, 4, n_wide, n_index)
    _counts(f, t, n_ids, n_words, n_bits, width)
    if version == 2.0:
        _biotypes(f, t)
    return t


def _numbers(t: LegacyTable, section: str, kind: str, first: int, n: int) -> np.ndarray | None:
    """``n`` numbers of a section from the ``first`` one on; None if the version has no such section."""
    if section not in t.sections:
        return None
    dtype = np.dtype(kind)
    return np.fromfile(t.path, dtype, n, offset=t.sections[section] + first * dtype.itemsize).astype(np.int64)


def _words(t: LegacyTable, first: int, n: int) -> np.ndarray | None:
    """Numbers of words of ``n`` keys."""
    offsets = _numbers(t, "offset", "<u4", first, n + 1)
    return np.diff(offsets) if offsets is not None else _numbers(t, "n_words", "<u2", first, n)


def _chunks(spark: SparkSession, t: LegacyTable, read, schema: str, names: list[str]) -> DataFrame:
    """Rows of ``read(first, n)``, which gives columns, over ranges of keys, one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                n = min(CHUNK, t.n_kmers - c * CHUNK)
                columns = read(c, c * CHUNK, n)
                size = max(len(x) for x in columns if x is not None)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in columns], names=names)

    chunks = -(-t.n_kmers // CHUNK)
    return spark.range(0, chunks, 1, max(1, chunks)).mapInArrow(run, schema)


def legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, kmer_bits, n_words, biotype_mask)``; null what the version does not give."""
    t = read_legacy(path)

    def read(_: int, first: int, n: int) -> list[np.ndarray | None]:
        mask = _numbers(t, "mask_id", "<u2", first, n)
        masks = np.array(t.pool, np.int64)[mask - 1] if mask is not None else None  # ids count from 1
        return [np.arange(first + 1, first + n + 1), _numbers(t, "key", "<u8", first, n), _words(t, first, n), masks]

    return _chunks(spark, t, read, "pos bigint, kmer_bits bigint, n_words bigint, biotype_mask bigint", ["pos", "kmer_bits", "n_words", "biotype_mask"])


def legacy_words(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, slot, word_id)``: the ids of the count words of every key, in their order."""
    t = read_legacy(path)
    if "word_id" not in t.sections:
        raise ValueError(f"a table of version {t.version} has no counts here")
    sums = _chunks(spark, t, lambda c, first, n: [np.array([c]), _words(t, first, n).sum(keepdims=True)], "chunk bigint, words bigint", ["chunk", "words"])
    ordered = [r.words for r in sums.orderBy("chunk").collect()]  # one row per million keys
    begin = [0, *accumulate(ordered)]

    def read(c: int, first: int, n: int) -> list[np.ndarray]:
        words = _words(t, first, n)
        before = np.cumsum(words) - words
        slot = np.arange(words.sum()) - np.repeat(before, words) + 1
        return [np.repeat(np.arange(first + 1, first + n + 1), words), slot, _numbers(t, "word_id", "<u4", begin[c], int(words.sum()))]

    return _chunks(spark, t, read, "pos bigint, slot bigint, word_id bigint", ["pos", "slot", "word_id"])
