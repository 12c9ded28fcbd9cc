"""Byte-level BPE encoding of a corpus with a public rank file.

``encode_corpus`` adds a column of token ids to every document, ``count_corpus`` only their number.
A text is cut into chunks at white space, a chunk into pretokens by the tokenizer's own pattern and
a pretoken into ids by merging byte pairs in rank order. Chunks repeat heavily in any corpus, so the
ids of a chunk are kept in a table of bounded size in each Python worker.

Merging keeps two contiguous arrays per word, the part boundaries and the rank of each adjacent
pair: it scans for the minimum, deletes that boundary and refreshes the two neighbouring ranks. The
scan is quadratic, so words beyond ``LONG_WORD`` bytes use a heap over the same ranks instead.

Defined results: a null or empty text gives an empty list and 0 tokens; lone surrogates are encoded
as U+FFFD; a repeated row gives a repeated row here (the queries keep replayed rows once); all other
input columns are dropped except ``key``, so clashing names cannot occur.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space as Unicode defines it; the tokenizers' ``\s`` means exactly these.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The public split pattern of the byte-level rank files (fixed value), with ``\s`` spelled out.
PRETOKENS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

#: Chunks end where a pretoken always ends: at white space (one blank belongs to the chunk after it)
#: and between the seconds and the fraction of a clock time, which would else hardly ever repeat.
CHUNKS = re.compile(
    rf" ?[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?=[,.][0-9]{{3}}(?:[{SPACE}]|\Z))|[,.][0-9]{{3}}(?=[{SPACE}]|\Z)"
    rf"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

LONG_WORD = 256
NO_PAIR = 1 << 60
#: Entries of the chunk table of one worker; it is emptied when full. Only shorter chunks enter it.
TABLE_SIZE, TABLE_CHUNK = 400_000, 64


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file, given its bytes."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    starts = list(range(len(word) + 1))
    of = ranks.get
    pair = [of(word[i : i + 2], NO_PAIR) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == NO_PAIR:
            break
        i = pair.index(low)
        del starts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = of(word[starts[i] : starts[i + 2]], NO_PAIR)
        if i:
            pair[i - 1] = of(word[starts[i - 1] : starts[i + 1]], NO_PAIR)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Table from chunk to its tuple of ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.words: dict[str, tuple[int, ...]] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for word in PRETOKENS.findall(chunk):
            known = self.words.get(word)
            if known is None:
                known = tuple(merge_word(word.encode("utf-8", "replace"), self.ranks))
                if len(word) <= TABLE_CHUNK:
                    if len(self.words) >= TABLE_SIZE:
                        self.words.clear()
                    self.words[word] = known
            ids += known
        if len(chunk) <= TABLE_CHUNK:
            if len(self) >= TABLE_SIZE:
                self.clear()
            self[chunk] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for chunk in CHUNKS.findall(clean(text)):
            ids += self[chunk]
        return ids


def clean(text: str | None) -> str:
    """``text`` without what UTF-8 cannot carry; empty for null."""
    if not text:
        return ""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        text = "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in text)
    return text


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(shipped) -> Encoder:
    """The encoder of this Python worker for a broadcast rank file."""
    if shipped.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shipped.id] = Encoder(load_ranks(shipped.data))
    return _ENCODERS[shipped.id]


class Ranks:
    """A rank file as it travels to the executors: of fixed size, about 1 MB."""

    def __init__(self, id: int, data: bytes):
        self.id, self.data = id, data


def ship_ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast(Ranks(hash(data), data))


def encode_corpus(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids ARRAY<INT>)`` for every row of ``df``."""
    shipped = ship_ranks(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder_of(shipped.value)
        chunks = CHUNKS.findall
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(1).to_pylist():
                if value:
                    for chunk in chunks(clean(value)):
                        flat += table[chunk]
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)``: the texts that lists of ids stand for; an id that is not in the file is an error."""
    shipped = ship_ranks(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in encoder_of(shipped.value).ranks.items()}
        for batch in batches:
            texts = [b"".join([bytes_of[i] for i in value or ()]).decode("utf-8", "replace") for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def count_corpus(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens BIGINT)`` for every row of ``df``."""
    shipped = ship_ranks(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder_of(shipped.value)
        look, chunks = table.__getitem__, CHUNKS.findall
        for batch in batches:
            sizes = [sum(map(len, map(look, chunks(clean(value))))) if value else 0 for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
