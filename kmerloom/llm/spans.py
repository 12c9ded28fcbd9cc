"""Long spans of text that stand verbatim in more than one document.

A suffix automaton of every reference text against every document is quadratic in the corpus, so the
automata are built per *anchor*: a window of ``ANCHOR`` characters chosen by winnowing (the smallest
hash among all windows of a run of ``min_length``), which every two texts that share such a run have
in common. Steps:

1. every text gives its anchors (hash, text, position); one aggregation finds the hashes that more
   than one text has, and a join drops all others;
2. the surroundings of the anchors left, wide enough to hold every run of ``min_length`` around the
   anchor, are cut out of the texts; equal surroundings under one anchor form a class;
3. the classes of an anchor are the shard of a generalised suffix automaton; each class is streamed
   through it, and its matching statistics give the maximal spans that other classes hold too, and
   the sets of classes that share a run of ``min_length``;
4. classes are expanded to texts and texts to documents.

A shared anchor without a long run around it yields nothing, so hash collisions cost time, not
truth. An anchor with more than ``SHARD_CLASSES`` classes (a formula with ever different
surroundings) is no job for one automaton: the surroundings of its classes are dealt out anew by longer
anchors, half way to ``min_length`` each time, which two of them that share a run have in common just
as well. At the last step the anchor is the run itself, so all that meet there hold it and the shard's
automaton is that of one string. Copies of a text are one text throughout and documents again only at
the end.

Defined results: null, empty and short texts have no spans and a share of 0; characters are code
points; repeated rows of one ``key`` are one document; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..durable import materialise, wide_parallelism

ANCHOR = 64
SHARD_CLASSES = 256
#: Classes for which one task builds automata, on average.
TASK_CLASSES = 20_000
BATCH_PIECES = 20_000
#: Characters fingerprinted at once; the position must fit the low bits of a winnowing key.
SEGMENT = 1 << 19
LOW_BITS = np.uint64((1 << 20) - 1)

_BASE = 0x9E3779B97F4A7C15
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS is None:
        def powers(base: int) -> np.ndarray:
            steps = np.full(SEGMENT + 1, base, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        _POWERS = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    return _POWERS


def _sliding(reduce, x: np.ndarray, width: int) -> np.ndarray:
    """``reduce`` over every ``width`` consecutive entries, by doubling."""
    done = 1
    while done * 2 <= width:
        x = reduce(x[:-done], x[done:])
        done *= 2
    return reduce(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def choose_anchors(codes: np.ndarray, valid: np.ndarray, min_length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows chosen in ``codes``; ``valid`` marks the starts of whole runs."""
    n = len(codes)
    up, down = _powers()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    windows = n - anchor + 1
    h = (sums[anchor:] - sums[:-anchor]) * down[:windows]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ranked = (h & ~LOW_BITS) | np.arange(windows, dtype=np.uint64)
    per_run = min_length - anchor + 1
    least = _sliding(np.minimum, ranked, per_run)
    least = least.copy() if per_run == 1 else least  # else it is a new array already
    least[~valid[: len(least)]] = 0
    padded = np.zeros(len(least) + 2 * (per_run - 1), dtype=np.uint64)
    padded[per_run - 1 : per_run - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(np.maximum, padded, per_run) == ranked)
    return at, h[at].view(np.int64)


def _segments(texts: list[str | None], min_length: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of ``(index, offset, piece)`` of at most SEGMENT characters in all; pieces of one text overlap."""
    group, held = [], 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        for start in range(0, max(0, n - min_length + 1), SEGMENT - min_length + 1):
            piece = text[start : start + SEGMENT] if n > SEGMENT else text
            if held + len(piece) > SEGMENT:
                yield group
                group, held = [], 0
            group.append((i, start, piece))
            held += len(piece)
    if group:
        yield group


def fingerprint(texts: list[str | None], min_length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, position and hash of every chosen anchor."""
    found = []
    for group in _segments(texts, min_length):
        codes = np.frombuffer("".join(p for _, _, p in group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        change = np.zeros(len(codes) + 1, dtype=np.int8)
        change[begins] += 1
        change[ends - min_length + 1] -= 1
        valid = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        at, h = choose_anchors(codes, valid, min_length, anchor)
        which = np.searchsorted(ends, at, side="right")
        index = np.array([i for i, _, _ in group])[which]
        offset = np.array([o for _, o, _ in group])[which]
        found.append((index, at - begins[which] + offset, h))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class SuffixAutomaton:
    """Generalised suffix automaton of a few strings; ``mask[v]`` has a bit per string that holds the state's words."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.mask = [-1], [0], [0]
        for k, s in enumerate(strings):
            self._add(s, 1 << k)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.mask[self.link[v]] |= self.mask[v]

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of state ``q`` for the words that reach it through ``p`` by ``c``."""
        nxt, link = self.next, self.link
        copy = len(link)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.mask.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def _add(self, s: str, bit: int) -> None:
        nxt, link, length, mask = self.next, self.link, self.length, self.mask
        last = 0
        for c in s:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                new = len(link)
                nxt.append({})
                length.append(length[last] + 1)
                mask.append(0)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            mask[last] |= bit


def shared_in_shard(strings: list[str], min_length: int, owners: list[tuple]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For every string its spans that stand in another text too, and the sets of strings (as bit masks) that share a run.

    ``owners`` has the least and the greatest text that holds each string: a word of the automaton
    stands in several texts if the owners of the strings that hold it are not all one text.
    """
    sam = SuffixAutomaton(strings)
    link, length, mask = sam.link, sam.length, sam.mask
    known: dict[int, bool] = {}

    def several(m: int) -> bool:
        if m not in known:
            held = [o for k, o in enumerate(owners) if m >> k & 1]
            known[m] = bool(held) and min(a for a, _ in held) != max(b for _, b in held)
        return known[m]

    shared, run = [0] * len(link), [0] * len(link)  # nearest ancestor in several texts; highest one of enough length
    for v in sorted(range(1, len(link)), key=length.__getitem__):
        shared[v] = v if several(mask[v]) else shared[link[v]]
        run[v] = run[link[v]] if length[link[v]] >= min_length else v
    sets: set[int] = set()
    spans: list[list[tuple[int, int]]] = []
    for s in strings:
        own: list[tuple[int, int]] = []
        v = 0
        for end, c in enumerate(s, 1):
            v = sam.next[v][c]
            u = shared[v]
            n = end if u == v else length[u]
            if n >= min_length:
                sets.add(mask[run[u]])
                if own and own[-1][1] >= end - n:
                    own[-1] = (min(own[-1][0], end - n), end)
                else:
                    own.append((end - n, end))
        spans.append(own)
    return spans, sorted(sets)


def _anchors(docs: DataFrame, min_length: int, anchor: int) -> DataFrame:
    """``(h, tid, pos)`` of every text; ``tid`` identifies the text by its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, pos, h = fingerprint(batch.column(1).to_pylist(), min_length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(index)), pa.array(pos)], names=["h", "tid", "pos"])

    return docs.select("tid", "text").mapInArrow(run, "h bigint, tid binary, pos bigint")


def _surroundings(located: DataFrame, min_length: int, anchor: int) -> DataFrame:
    """``(h, cls, tid, starts, piece)``: the surroundings of the anchors of every text, equal ones once."""
    margin = min_length - anchor

    def rows(h: list[int], tid: list[bytes], starts: list[list[int]], piece: list[str]) -> pa.RecordBatch:
        cls = [hashlib.md5(p.encode("utf-8", "surrogatepass")).digest() for p in piece]
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(cls, pa.binary()), pa.array(tid, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(piece, pa.string())],
            names=["h", "cls", "tid", "starts", "piece"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, tids, starts, pieces = [], [], [], []
        for batch in batches:
            for tid, text, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                at: dict[tuple[int, str], list[int]] = {}
                for a in anchors:
                    start = max(0, a["pos"] - margin)
                    at.setdefault((a["h"], text[start : a["pos"] + min_length]), []).append(start)
                for (h, piece), where in at.items():
                    hs.append(h)
                    tids.append(tid)
                    starts.append(sorted(set(where)))
                    pieces.append(piece)
                if len(pieces) > BATCH_PIECES:
                    yield rows(hs, tids, starts, pieces)
                    hs, tids, starts, pieces = [], [], [], []
        yield rows(hs, tids, starts, pieces)

    return located.select("tid", "text", "anchors").mapInArrow(run, "h bigint, cls binary, tid binary, starts array<bigint>, piece string")


#: A result of step 3: a class, the numbers of the sets of its anchor it belongs to, its shared spans.
CLASS_ROWS = "h bigint, cls binary, groups array<string>, spans array<struct<start: int, stop: int>>"


def _by_automata(classes: DataFrame, min_length: int, anchor: int) -> DataFrame:
    """Run the automaton of every anchor of a length; ``classes`` has (h, cls, piece, low, high), all of one ``h`` fit in a task."""

    def solve(h: int, rows: list[dict]) -> Iterator[dict]:
        owners = [(r["low"], r["high"]) for r in rows]
        if len(rows) > 1:
            spans, sets = shared_in_shard([r["piece"] for r in rows], min_length, owners)
        else:  # the automaton of one string accepts all of it
            spans, sets = [[(0, len(rows[0]["piece"]))] if owners[0][0] != owners[0][1] else []], [1]
        for i, r in enumerate(rows):
            if spans[i]:
                groups = [f"{anchor}.{k}" for k, m in enumerate(sets) if m >> i & 1]
                yield {"h": h, "cls": r["cls"], "groups": groups, "spans": [{"start": a, "stop": b} for a, b in spans[i]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["h"] != r["h"]:
                    out += solve(held[0]["h"], held)
                    held = []
                held.append(r)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if held:
            out += solve(held[0]["h"], held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("cls", pa.binary()), ("groups", pa.list_(pa.string())), ("spans", span)])
    # Partitions by the number of classes: their few bytes would else be joined into too few tasks for the work.
    parts = max(wide_parallelism(classes.sparkSession), -(-classes.count() // TASK_CLASSES))
    return classes.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, CLASS_ROWS)


def _classes(pieces: DataFrame) -> DataFrame:
    """``(h, cls, piece, low, high)`` of the pieces of texts: equal pieces once, with the least and the greatest text that holds them."""
    return pieces.groupBy("h", "cls").agg(F.min("piece").alias("piece"), F.min("tid").alias("low"), F.max("tid").alias("high"))


def _longer_anchors(pieces: DataFrame, classes: DataFrame, min_length: int, anchor: int) -> DataFrame:
    """``pieces`` cut anew around anchors of ``anchor`` characters, which are found once in each of their ``classes``."""
    margin = min_length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            index, pos, h = fingerprint(texts, min_length, anchor)
            start = np.maximum(pos - margin, 0)
            cut = [texts[i][a : p + min_length] for i, a, p in zip(index.tolist(), start.tolist(), pos.tolist())]
            cls = [hashlib.md5(p.encode("utf-8", "surrogatepass")).digest() for p in cut]
            rows = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h), pa.array(cls, pa.binary()), pa.array(start), pa.array(cut, pa.string())],
                names=["h", "cls", "h2", "cls2", "at", "piece"],
            )

    finer = classes.select("h", "cls", "piece").mapInArrow(run, "h bigint, cls binary, h2 bigint, cls2 binary, at bigint, piece string")
    placed = pieces.select("h", "cls", "tid", "starts").join(finer, ["h", "cls"]).select(
        F.col("h2").alias("h"), F.col("cls2").alias("cls"), "tid", F.transform("starts", lambda s: s + F.col("at")).alias("starts"), "piece"
    )
    return placed.groupBy("h", "cls", "tid").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.min("piece").alias("piece"))


class SharedSpans:
    """The shared runs of a corpus, ready to be asked for pairs, spans and shares."""

    def __init__(self, df: DataFrame, min_length: int = 200, *, key: str = "doc_id", text: str = "text", anchor: int = ANCHOR, shard_classes: int = SHARD_CLASSES):
        if not 0 < anchor < min_length:
            raise ValueError("anchor must be shorter than min_length")
        self.key, self.min_length = key, min_length
        docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
        long = docs.where(F.length("text") >= min_length).withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))
        self.lengths = docs.groupBy("key").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
        spark = df.sparkSession
        # A filter on the ids of texts with shared anchors spares the shuffle of all other texts. It has a fixed number of bits, 1 MB.
        wanted = {
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
        }
        before = {k: spark.conf.get(k) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)
        try:
            self._prepare(long, anchor, shard_classes)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    def _prepare(self, long: DataFrame, anchor: int, shard_classes: int) -> None:
        self.copies = materialise(long.groupBy("key", "tid").agg(F.lit(1).alias("one")).drop("one"), "texts")
        points = materialise(_anchors(long, self.min_length, anchor), "anchors")
        # Two hashes of a text's id, not the id: numbers are aggregated in a hash table, binaries by sorting.
        a, b = F.xxhash64("tid"), F.hash("tid")
        shared = points.groupBy("h").agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
        shared = materialise(shared.where("a0 < a1 or b0 < b1").select("h", F.lit(2).alias("n")), "shared")
        found = points.join(shared.where("n > 1").select("h"), "h")
        by_text = found.groupBy("tid").agg(F.collect_set(F.struct("h", "pos")).alias("anchors"))
        first = self.copies.groupBy("tid").agg(F.min("key").alias("key"))
        by_text = materialise(by_text.join(first, "tid").withColumn("n", F.size("anchors")), "located")
        located = long.select("key", "tid", "text").join(by_text.where("n > 0").select("key", "tid", "anchors"), ["key", "tid"]).dropDuplicates(["tid"])
        pieces = materialise(_surroundings(located, self.min_length, anchor), "pieces")
        done = []
        while True:
            classes = materialise(_classes(pieces), "classes")
            large = materialise(classes.groupBy("h").count().where(F.col("count") > shard_classes).select("h"), "large")
            if anchor == self.min_length or large.isEmpty():
                done.append((pieces, _by_automata(classes, self.min_length, anchor)))
                break
            done.append((pieces.join(large, "h", "left_anti"), _by_automata(classes.join(large, "h", "left_anti"), self.min_length, anchor)))
            anchor = (anchor + self.min_length + 1) // 2
            some = pieces.join(large, "h", "left_semi"), classes.join(large, "h", "left_semi")
            pieces = materialise(_longer_anchors(*some, self.min_length, anchor), "pieces")
        self.pieces = done[0][0]
        solved = done[0][1]
        for more, rows in done[1:]:
            self.pieces, solved = self.pieces.unionByName(more), solved.unionByName(rows)
        self.solved = materialise(solved, "solved")

    def pairs(self) -> DataFrame:
        """``(doc_a, doc_b)``, doc_a < doc_b, of all documents that share a run, copies included."""
        held = self.pieces.select("h", "cls", "tid").join(self.solved.select("h", "cls", "groups"), ["h", "cls"])
        held = materialise(held.select("h", F.explode("groups").alias("g"), "tid").distinct(), "held")
        # A passage has many anchors, mostly held by the same texts: one of the groups with the same members gives their pairs.
        members = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y"))
        once = members.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("h", "g")).alias("of")).select("of.h", "of.g")
        held = held.join(once, ["h", "g"], "left_semi")
        other = held.withColumnRenamed("tid", "tid_b")
        texts = held.withColumnRenamed("tid", "tid_a").join(other, ["h", "g"]).where("tid_a < tid_b").select("tid_a", "tid_b").distinct()
        a = self.copies.select(F.col("tid").alias("tid_a"), F.col("key").alias("ka"))
        b = self.copies.select(F.col("tid").alias("tid_b"), F.col("key").alias("kb"))
        crossed = texts.join(a, "tid_a").join(b, "tid_b").select("ka", "kb")
        equal = a.join(b, F.col("tid_a") == F.col("tid_b")).where("ka < kb").select("ka", "kb")
        both = crossed.select(F.least("ka", "kb").alias("doc_a"), F.greatest("ka", "kb").alias("doc_b")).where("doc_a <> doc_b")
        return both.union(equal.toDF("doc_a", "doc_b")).distinct()

    def _text_spans(self) -> DataFrame:
        """``(tid, start, stop)`` of the maximal stretches that other texts hold too."""
        at = self.pieces.select("h", "cls", "tid", "starts").join(self.solved.select("h", "cls", "spans"), ["h", "cls"])
        at = at.select("tid", F.explode("starts").alias("s"), "spans").select("tid", "s", F.explode("spans").alias("x"))
        at = at.select("tid", (F.col("s") + F.col("x.start")).alias("start"), (F.col("s") + F.col("x.stop")).alias("stop")).distinct()
        order = Window.partitionBy("tid").orderBy("start", "stop")
        reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
        at = at.withColumn("new", F.when(F.col("start") > reach, 1).when(reach.isNull(), 1).otherwise(0))
        at = at.withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return at.groupBy("tid", "no").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("no")

    def spans(self) -> DataFrame:
        """``(key, span_start, span_stop)``: what stands in another document; a copied text is one span."""
        n_copies = self.copies.groupBy("tid").agg(F.count(F.lit(1)).alias("n_docs"))
        copies = self.copies.join(n_copies.where("n_docs > 1").select("tid"), "tid", "left_semi")
        whole = copies.join(self.lengths, "key").select("key", F.lit(0).cast("long").alias("start"), F.col("n_chars").cast("long").alias("stop"))
        part = self.copies.join(copies.select("tid").distinct(), "tid", "left_anti").join(self._text_spans(), "tid").select("key", "start", "stop")
        return part.unionByName(whole).select(F.col("key").alias(self.key), F.col("start").alias("span_start"), F.col("stop").alias("span_stop"))

    def shares(self) -> DataFrame:
        """``(key, n_chars, shared_chars, share)`` for every document."""
        held = self.spans().groupBy(F.col(self.key).alias("key")).agg(F.sum(F.col("span_stop") - F.col("span_start")).alias("shared_chars"))
        shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
        return self.lengths.join(held, "key", "left").select(
            F.col("key").alias(self.key), "n_chars", shared.alias("shared_chars"),
            F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"),
        )
