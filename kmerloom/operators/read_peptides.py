"""The peptides of reads against the samples of the same reads, almost without moving k-mers.

Nearly all k-mers of long peptides occur once in all reads. Such a k-mer is found once by its own sample and by no other, so
its peptide can be summed up where it is cut. Which k-mers occur again is settled by their hashes: every segment of reads (one
packed row of a written table) sends the sorted hashes of its windows, coded in about two bytes each, to the tasks of their
ranges, which give back to each segment those that were seen elsewhere too or twice. The windows with such a hash, and no
others, are then shuffled with their whole keys, counted by sample and joined. A hash that two keys share by chance only sends
along a key that turns out to occur once; the figures are exact for any hash. Equal reads are one read with many keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..constants import CODON64
from ..durable import materialise, wide_parallelism
from ..functions.kmers import residues_of, usable_read
from ..functions.vectorised import genetic_code, stop_free_windows, usable_segments

#: Bases of a segment, about.
SEGMENT_BASES = 1 << 20
#: Hashes in a range, about, as a power of two.
RANGE_BITS = 20
#: Bits of a hash beyond those that number all bases: one window in 2 ** SPARE_BITS, at most, has the hash of another key.
SPARE_BITS = 9
#: Bits of a hash by which most windows are told from all returned ones by one look into a table.
TABLE_BITS = 22


def _hashes(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of a mixed key."""
    x = keys.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x >> np.uint64(64 - bits)


def _coded(rising: np.ndarray, low: int) -> tuple[bytes, bytes]:
    """Rising numbers, one or more: their parts above ``low`` bits in unary, and the bytes of the parts below."""
    high = (rising >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(len(high) + int(high[-1]), np.uint8)
    unary[high + np.arange(len(high))] = 1
    below = rising & np.uint64((1 << low) - 1)
    return np.packbits(unary).tobytes(), below.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-low // 8)].tobytes()


def _decoded(high: bytes, below: bytes, low: int) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))
    whole = np.zeros((len(ones), 8), np.uint8)
    if low:
        whole[:, : -(-low // 8)] = np.frombuffer(below, np.uint8).reshape(len(ones), -1)
    return ((ones - np.arange(len(ones))).astype(np.uint64) << np.uint64(low)) | whole.view("<u8").ravel()


def _low_bits(n: int, bits: int, ranges: int) -> int:
    """Bits below the unary part of ``n`` hashes: whole bytes at about one step a hash, but no step longer than a range."""
    steps = max(ranges, n.bit_length())
    return bits - max(ranges, bits - 8 * -(-(bits - steps) // 8))


def _packed(bases: np.ndarray) -> bytes:
    four = np.concatenate([bases, np.zeros(-len(bases) % 4, np.uint8)]).reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()


def _read(borders: bytes, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Base codes and borders of a segment."""
    borders = np.frombuffer(borders, np.int64)
    four = np.frombuffer(packed, np.uint8)
    bases = np.empty((len(four), 4), np.uint8)
    for i in range(4):
        bases[:, i] = four >> (6 - 2 * i) & 3
    return bases.ravel()[: borders[-1]], borders


def _distinct_reads(reads: DataFrame, k: int, key: str, seq: str, sample: str) -> DataFrame:
    """``(seq, keys, samples)``: every usable read once, with the keys and, counted, the samples it has.

    Only reads whose hash occurs more than once are shuffled whole.
    """
    rows = reads.where(usable_read(F.col(seq), k)).select(F.col(key).alias("key"), F.col(sample).alias("sample"), F.col(seq).alias("seq"), F.xxhash64(seq).alias("hash"))
    single = rows.select("seq", F.array("key").alias("keys"), F.array(F.struct("sample", F.lit(1).cast("bigint").alias("copies"))).alias("samples"), "hash")
    more = materialise(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "equal_reads")
    if more.isEmpty():
        return single.drop("hash")
    # A null is no element of a collected list, but a structure that holds it is.
    copies = rows.join(more, "hash", "left_semi").groupBy("seq", "sample").agg(F.collect_list(F.struct("key")).alias("of"), F.count(F.lit(1)).alias("copies"))
    equal = copies.groupBy("seq").agg(F.flatten(F.collect_list("of")).alias("of"), F.collect_list(F.struct("sample", "copies")).alias("samples"))
    equal = equal.select("seq", F.transform(F.array_distinct("of"), lambda x: x["key"]).alias("keys"), "samples")
    return single.join(more, "hash", "left_anti").drop("hash").unionByName(equal)


def _segments(reads: DataFrame, k: int) -> DataFrame:
    """``(seg, n_bases, keys, samples, borders, bases)``: the usable reads, many to a row, two bits a base."""
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, bases, borders in usable_segments(batch.column("seq"), k):
                cuts = np.unique(np.searchsorted(borders, np.arange(0, borders[-1], SEGMENT_BASES)).tolist() + [len(rows)])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    part, own = bases[borders[a] : borders[b]], borders[a : b + 1] - borders[a]
                    one = lambda c: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).take(pa.array(rows[a:b])))  # noqa: B023, E731
                    columns = [pa.array([seg]), pa.array([len(part)], pa.int64()), one("keys"), one("samples"), pa.array([own.astype(np.int64).tobytes()]), pa.array([_packed(part)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["seg", "n_bases", "keys", "samples", "borders", "bases"])
                    seg += 1

    return reads.select("keys", "samples", "seq").mapInArrow(run, f"seg bigint, n_bases bigint, keys array<{kinds['keys']}>, samples array<{kinds['samples']}>, borders binary, bases binary")


def _seen_again(segments: DataFrame, k: int, code: np.ndarray, bits: int, ranges: int) -> DataFrame:
    """``(seg, range, low, high, below)``: for every segment and range, the hashes of its windows that other segments have too, or it has twice.

    ``bits`` of a hash are compared, by ``2 ** ranges`` ranges.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, borders, packed in zip(*(batch.column(c).to_pylist() for c in ("seg", "borders", "bases"))):
                bases, borders = _read(borders, packed)
                _, keys, _ = stop_free_windows(bases, borders, slice(None), k, code)
                if not len(keys):
                    continue
                hashes = np.sort(_hashes(keys, bits))
                again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
                twice, once = np.unique(hashes[again]), hashes[~again]
                low = _low_bits(len(once), bits, ranges)
                edges = np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(bits - ranges)
                cut, cut_twice = np.searchsorted(once, edges), np.searchsorted(twice, edges)
                rows = []
                for r in np.flatnonzero(np.diff(cut)):
                    high, below = _coded(once[cut[r] : cut[r + 1]] - edges[r], low)
                    rows.append((int(r), seg, low, high, below, twice[cut_twice[r] : cut_twice[r + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "seg", "low", "high", "below", "twice"])

    def compare(table: pa.Table) -> pa.Table:
        start = np.uint64(table.column("range")[0].as_py()) << np.uint64(bits - ranges)
        rows = table.select(["seg", "low", "high", "below", "twice"]).to_pylist()
        parts = [_decoded(r["high"], r["below"], r["low"]) + start for r in rows]
        merged = np.sort(np.concatenate(parts))
        common = np.unique(merged[1:][merged[1:] == merged[:-1]])
        out = []
        for r, own in zip(rows, parts):
            at = np.minimum(np.searchsorted(own, common), len(own) - 1)
            back = np.union1d(common[own[at] == common], np.frombuffer(r["twice"], np.uint64))
            if len(back):
                low = _low_bits(len(back) << ranges, bits, ranges)
                out.append((r["seg"], table.column("range")[0].as_py(), low, *_coded(back - start, low)))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(zip(("seg", "range", "low", "high", "below"), kinds))})

    sent = segments.select("seg", "borders", "bases").mapInArrow(send, "range int, seg bigint, low int, high binary, below binary, twice binary")
    return sent.repartition(wide_parallelism(segments.sparkSession), "range").groupBy("range").applyInArrow(compare, "seg bigint, range int, low int, high binary, below binary")


def _repeated_reads(segments: DataFrame) -> DataFrame:
    """``(seg, places)`` of reads whose key other reads have too."""
    rows = segments.select("seg", F.posexplode("keys").alias("place", "keys")).select("seg", "place", F.explode("keys").alias("key"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("again"))
    return rows.join(keys.hint("merge"), F.col("key").eqNullSafe(F.col("again")), "left_semi").groupBy("seg").agg(F.collect_list("place").alias("places"))


def _pieces(segments: DataFrame, k: int, code: np.ndarray, bits: int, ranges: int) -> DataFrame:
    """``(kmer_bits, keys, frame, i, samples, n_kmers, n, alone)`` of segments with what was returned to them.

    With a null ``kmer_bits``: a peptide and the number ``n`` of its k-mers that occur nowhere else, ``alone`` if those are all.
    Else a k-mer of a peptide that may occur elsewhere, and how often the peptide has it. ``n_kmers`` are the distinct k-mers,
    null where other reads have the same key.
    """
    kinds = {f.name: f.dataType.elementType.simpleString() for f in segments.schema.fields if f.name in ("keys", "samples")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                r = {c: batch.column(c)[b] for c in ("keys", "samples", "borders", "bases", "hashes", "places")}
                bases, borders = _read(r["borders"].as_py(), r["bases"].as_py())
                at, keys, stop = stop_free_windows(bases, borders, slice(None), k, code)
                if not len(at):
                    continue
                before = np.zeros(len(stop), np.int64)  # stops of the same frame before each base
                for g in range(3):
                    before[g::3] = np.cumsum(stop[g::3]) - stop[g::3]
                order = np.concatenate([np.flatnonzero(at % 3 == g) for g in range(3)])  # the windows of a peptide follow each other
                at, keys = at[order], keys[order]
                read = np.searchsorted(borders, at, side="right") - 1
                frame = (at - borders[read]) % 3
                piece = before[at] - before[borders[read] + frame]
                new = np.concatenate([[True], (read[1:] != read[:-1]) | (frame[1:] != frame[:-1]) | (piece[1:] != piece[:-1])])
                first, peptide = np.flatnonzero(new), np.cumsum(new) - 1

                flagged = np.zeros(len(at), bool)
                back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_decoded(h["high"], h["below"], h["low"]) + (np.uint64(h["range"]) << np.uint64(bits - ranges)) for h in r["hashes"].as_py() or ())]))
                if len(back):
                    hashes, shift = _hashes(keys, bits), np.uint64(max(0, bits - TABLE_BITS))
                    known = np.zeros(1 << min(bits, TABLE_BITS), bool)
                    known[back >> shift] = True
                    likely = np.flatnonzero(known[hashes >> shift])
                    found = np.minimum(np.searchsorted(back, hashes[likely]), len(back) - 1)
                    flagged[likely[back[found] == hashes[likely]]] = True
                repeated = np.zeros(len(borders) - 1, bool)
                repeated[np.array(r["places"].as_py() or (), np.int64)] = True
                flagged |= repeated[read]

                plain = np.add.reduceat(~flagged, first, dtype=np.int64)
                own, kmer = peptide[flagged], keys[flagged]
                by = np.lexsort((kmer, own))
                own, kmer = own[by], kmer[by]
                start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (kmer[1:] != kmer[:-1])])) if len(own) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(own)))
                own, kmer = own[start], kmer[start]
                others = np.bincount(own, minlength=len(first))
                left = np.flatnonzero(plain)

                which = np.concatenate([left, own])
                of = read[first[which]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(len(left), np.int64), kmer]), mask=np.arange(len(which)) < len(left)), r["keys"].values.take(pa.array(of)),
                        pa.array(frame[first[which]].astype(np.int32)), pa.array(piece[first[which]].astype(np.int32)), r["samples"].values.take(pa.array(of)),
                        pa.array((plain + others)[which].astype(np.int32), mask=repeated[of]), pa.array(np.concatenate([plain[left], times])), pa.array(others[which] == 0),
                    ],
                    names=["kmer_bits", "keys", "frame", "i", "samples", "n_kmers", "n", "alone"],
                )

    return segments.mapInArrow(run, f"kmer_bits bigint, keys {kinds['keys']}, frame int, i int, samples {kinds['samples']}, n_kmers int, n bigint, alone boolean")


def read_peptide_hits(reads: DataFrame, k: int, *, key: str = "rec_id", seq: str = "seq", sample: str = "sample_idx", code: str = CODON64) -> DataFrame:
    """``(key, frame, i, sample, n_kmers, matched, min_cnt, sum_cnt, coverage)`` of the reads' own peptides.

    The peptides of the three frames of every usable read are cut at stops, pieces numbered by ``i`` from 0; those that hold
    k-mers meet the counts of all reads by sample, as in ``peptide_hits``. Reads with equal (or null) keys share their peptides.
    Reads that are null, short or hold other symbols than bases give none; a null sample is a sample.
    """
    residues_of(k)
    letters, _ = genetic_code(code)
    segments = materialise(_segments(_distinct_reads(reads, k, key, seq, sample), k), "segments")
    number = int(segments.agg(F.sum("n_bases")).first()[0] or 1).bit_length()
    bits, ranges = min(64, number + SPARE_BITS), max(0, number - RANGE_BITS)
    again = materialise(_repeated_reads(segments), "repeated_reads")
    any_again = not again.isEmpty()

    # What comes back may be far more than the planner can know, so it is never broadcast.
    back = _seen_again(segments, k, letters, bits, ranges).groupBy("seg").agg(F.collect_list(F.struct("range", "low", "high", "below")).alias("hashes"))
    met = segments.repartition(wide_parallelism(reads.sparkSession), "seg").join(back.hint("merge"), "seg", "left")
    met = met.join(again.hint("merge"), "seg", "left") if any_again else met.withColumn("places", F.lit(None).cast("array<int>"))
    pieces = materialise(_pieces(met.select("keys", "samples", "borders", "bases", "hashes", "places"), k, letters, bits, ranges), "pieces")

    peptide = [key, "frame", "i"]
    of_sample = [F.col("s.sample").alias(sample), F.col("s.copies").alias("copies")]
    once = pieces.where("kmer_bits is null").withColumn("s", F.explode("samples")).select(F.explode("keys").alias(key), "frame", "i", *of_sample, "n_kmers", "n", "alone")
    once = once.select(*peptide, sample, "n_kmers", F.col("n").alias("matched"), F.col("copies").alias("min_cnt"), (F.col("n") * F.col("copies")).alias("sum_cnt"), "alone")
    found = pieces.where("kmer_bits is not null")
    counts = found.select("kmer_bits", "n", F.explode("samples").alias("s")).select("kmer_bits", "n", *of_sample).groupBy("kmer_bits", sample).agg(F.sum(F.col("n") * F.col("copies")).alias("cnt"))
    shared = found.select("kmer_bits", F.explode("keys").alias(key), "frame", "i", "n_kmers")
    own = shared.groupBy("kmer_bits", *peptide).agg(F.max("n_kmers").alias("n_kmers"))
    hits = own.join(counts.hint("merge"), "kmer_bits").select(*peptide, sample, "n_kmers", F.lit(1).cast("bigint").alias("matched"), F.col("cnt").alias("min_cnt"), F.col("cnt").alias("sum_cnt"))
    hits = hits.unionByName(once.where("not alone").drop("alone")).groupBy(*peptide, sample).agg(F.max("n_kmers").alias("n_kmers"), F.sum("matched").alias("matched"), F.min("min_cnt").alias("min_cnt"), F.sum("sum_cnt").alias("sum_cnt"))
    if any_again:
        sizes = own.where("n_kmers is null").groupBy(*peptide).agg(F.count(F.lit(1)).cast("int").alias("size")).select(F.col(key).alias("__key"), F.col("frame").alias("__frame"), F.col("i").alias("__i"), "size")
        same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("frame") == F.col("__frame")) & (F.col("i") == F.col("__i"))
        hits = hits.join(sizes.hint("merge"), same, "left").withColumn("n_kmers", F.coalesce("n_kmers", "size"))
    columns = [*peptide, sample, "n_kmers", "matched", "min_cnt", "sum_cnt"]
    rows = once.where("alone").select(columns).unionByName(hits.select(columns))
    return rows.withColumn("coverage", F.col("matched") / F.col("n_kmers"))
