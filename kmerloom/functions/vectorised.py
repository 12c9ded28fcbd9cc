"""Translation and k-mer windows of whole Arrow batches of reads.

All bases of a batch lie in one byte array. Codons are numbers, a table turns them into 5-bit residue
codes, and the packed keys of all windows come from a few shifts: the key of 2w residues at a base is
the key of w residues there and the one 3w bases on. Equal keys of a group are counted (or just kept
once) per batch, so that what reaches the JVM, and then the one shuffle, are numbers and partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..constants import AA28, BITS_PER_RESIDUE, CODON64
from .kmers import residues_of

#: Bases that are worked on at once.
SEGMENT = 1 << 22
NO_BASE = 4

_BASES = np.full(256, NO_BASE, np.uint8)
for _i, _letters in enumerate(("Aa", "Cc", "Gg", "TtUu")):
    _BASES[np.frombuffer(_letters.encode(), np.uint8)] = _i


def genetic_code(code: str) -> tuple[np.ndarray, np.ndarray]:
    """5-bit codes and letters of the 64 codons."""
    if len(code) != 64 or any(c not in AA28 for c in code):
        raise ValueError("a genetic code has 64 letters of the residue alphabet")
    return np.array([AA28.index(c) for c in code], np.int64), np.frombuffer(code.encode(), np.uint8)


def _segments(reads: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, base codes, row borders)`` of runs of rows; a null read is an empty one."""
    reads = reads.cast(pa.large_string())
    offsets = np.frombuffer(reads.buffers()[1], np.int64)[reads.offset : reads.offset + len(reads) + 1]
    data = np.frombuffer(reads.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(reads):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, side="right")) - 1)
        last = min(last, len(reads))
        yield first, _BASES[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        first = last


def _usable(bases: np.ndarray, borders: np.ndarray, k: int) -> np.ndarray:
    """Rows that are long enough and hold nothing but bases."""
    wrong = np.concatenate([[0], np.cumsum(bases == NO_BASE)])
    return (np.diff(borders) >= k) & (wrong[borders[1:]] == wrong[borders[:-1]])


def _codons(bases: np.ndarray) -> np.ndarray:
    """Number of the codon that starts at each base but the last two; meaningless where it is not all bases."""
    b = bases.astype(np.int64)
    return ((b[:-2] << 4) + (b[1:-1] << 2) + b[2:]) & 63


def _window(x: np.ndarray, residues: int, join) -> np.ndarray:
    """``x`` of single residues at every base, joined over ``residues`` of them, by doubling."""
    powers, w = {1: x}, 1
    while 2 * w <= residues:
        powers[2 * w] = join(powers[w][: len(powers[w]) - 3 * w], powers[w][3 * w :], w)
        w *= 2
    done, out = w, powers[w]
    for w in sorted((p for p in powers if p < w), reverse=True):
        if residues - done >= w:
            n = len(out) - 3 * w
            out = join(out[:n], powers[w][3 * done : 3 * done + n], w)
            done += w
    return out


def stop_free_windows(bases: np.ndarray, borders: np.ndarray, good: np.ndarray, k: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the stop-free windows of ``k`` bases of the ``good`` rows start, their keys, and at which bases a stop codon starts."""
    residues, stop = residues_of(k), AA28.index("*")
    if len(bases) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(max(0, len(bases) - 2), bool)
    change = np.zeros(len(bases) + 1, np.int32)
    np.add.at(change, borders[:-1][good], 1)
    np.add.at(change, borders[1:][good] - k + 1, -1)
    start = np.cumsum(change[: len(bases) - k + 1]) > 0
    aa = code[_codons(bases)]
    keys = _window(aa, residues, lambda a, b, w: (a << (BITS_PER_RESIDUE * w)) | b)
    stops = _window(aa == stop, residues, lambda a, b, w: a | b)
    at = np.flatnonzero(start & ~stops)
    return at, keys[at], aa == stop


def window_keys(reads: pa.Array, k: int, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, key)`` of all stop-free windows of ``k`` bases of the usable reads."""
    for first, bases, borders in _segments(reads):
        if len(bases) < k:
            continue
        at, keys, _ = stop_free_windows(bases, borders, _usable(bases, borders, k), k, code)
        yield first + np.searchsorted(borders, at, side="right") - 1, keys


def usable_segments(reads: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, base codes, borders)`` of the usable reads alone, by segments that have any."""
    for first, bases, borders in _segments(reads):
        good = _usable(bases, borders, k)
        if good.any():
            length = np.diff(borders)
            yield first + np.flatnonzero(good), bases[np.repeat(good, length)], np.concatenate([[0], np.cumsum(length[good])])


def _groups(batch: pa.RecordBatch, keep: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's combination of ``keep`` and a row that has it."""
    number = np.zeros(batch.num_rows, np.int64)
    for name in keep:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        number = number * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False)
        _, number = np.unique(number, return_inverse=True)
    _, sample = np.unique(number, return_index=True)
    return number, sample


def grouped_kmers(df: DataFrame, seq: str, k: int, *keep: str, code: str = CODON64) -> DataFrame:
    """``(keep.., kmer_bits, n)``: the stop-free k-mers of usable reads, counted per Arrow batch.

    Reads that are null, short or hold other symbols than bases give none. The rows are partial counts: sum them.
    """
    residues = residues_of(k)
    table, _ = genetic_code(code)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def counted(group: np.ndarray, key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = BITS_PER_RESIDUE * residues
        if bits + max(1, groups - 1).bit_length() <= 63:
            both, n = np.unique((group << bits) | key, return_counts=True)
            return both >> bits, both & ((1 << bits) - 1), n
        order = np.lexsort((key, group))
        group, key = group[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
        return group[first], key[first], np.diff(np.append(first, len(key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, sample = _groups(batch, list(keep))
            for row, key in window_keys(batch.column(seq), k, table):
                if len(key):
                    group, key, n = counted(number[row], key, len(sample))
                    rows = pa.array(sample[group])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), pa.array(key), pa.array(n.astype(np.int64))], names=[*keep, "kmer_bits", "n"])

    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "kmer_bits bigint", "n bigint"])
    return df.select(*keep, seq).mapInArrow(run, out)


def frame_peptides(df: DataFrame, seq: str, k: int, *keep: str, code: str = CODON64) -> DataFrame:
    """``(keep.., frame, peptide)``: the three frames of every usable read, stops written as ``*``; a partial codon at the end is ignored."""
    _, letters = genetic_code(code)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bases, borders in _segments(batch.column(seq)):
                good = np.flatnonzero(_usable(bases, borders, k))
                if not len(good):
                    continue
                aa = letters[_codons(bases)]
                row = np.repeat(good, 3)
                frame = np.tile(np.arange(3), len(good))
                length = (borders[row + 1] - borders[row] - frame) // 3
                ends = np.cumsum(length)
                at = np.repeat(borders[row] + frame - 3 * (ends - length), length) + 3 * np.arange(ends[-1])
                text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(aa[at])).cast(pa.string())
                rows = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), pa.array(frame.astype(np.int32)), text], names=[*keep, "frame", "peptide"])

    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "frame int", "peptide string"])
    return df.select(*keep, seq).mapInArrow(run, out)
