"""Loading raw annotation lines and transcript records, with a reason for every one that fails.

A line is parsed at minimum cost: a dynamic programme over its characters and the states of the
grammar may insert or delete quotes and delimiters (tab, semicolon, blank) at a cost of one each. A
line of cost zero whose values have the right types is a record; for any other line the cheapest
edits, or the types that failed, are the reason. The accepting run of cost zero is an ordinary
regular expression, so well-formed lines are recognised and split inside the JVM and only the others
reach the programme, which takes a step for a whole batch of lines at once. A transcript record has a
programme of the same kind, over runs of its characters.

Defined results: a null line or record fails with the reason ``null``; comments and blank lines of
an annotation file are skipped; null file names and late rows do not matter; a row that was
delivered again under a new id is a row of its own; equal rows come out once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import last_wins_map

DIGITS = r"\A[0-9]{1,18}\z"
NAME = "[A-Za-z_][A-Za-z0-9_]*+"
ITEM = rf' *+{NAME} ++(?:"[^"]*+"|[0-9]++) *+'
ATTRIBUTES = rf"\A{ITEM}(?:;{ITEM})*+;? *+\z"
PAIRS = rf'({NAME}) ++(?:"([^"]*+)"|([0-9]++))'
SYMBOLS = "ACGTURYSWKMBDHVN"

# States of a line: fields 1 to 8, then inside field 9 before an item, before an item after ';', in a
# name, after a name, in quotes, in a bare value, after a value.
FIELDS, (FIRST, NEXT, IN_NAME, GAP, QUOTED, BARE, DONE), STATES = 8, range(8, 15), 15
ACCEPTING = (NEXT, BARE, DONE)
TAB, SEMICOLON, QUOTE, BLANK, OTHER = range(5)
CLASS_OF = {"\t": TAB, ";": SEMICOLON, '"': QUOTE, " ": BLANK}
NAMES = {TAB: "tab", SEMICOLON: "semicolon", QUOTE: "quote", BLANK: "blank", OTHER: "name or value"}
#: Cost of a name or value that is not there at all.
MISSING = 4
FAR = 1 << 20


def _step(state: int, kind: int) -> int | None:
    """The state after a character of ``kind``, or None."""
    if state < FIELDS:
        return state + 1 if kind == TAB else state
    return {
        FIRST: {BLANK: FIRST, OTHER: IN_NAME},
        NEXT: {BLANK: NEXT, OTHER: IN_NAME},
        IN_NAME: {OTHER: IN_NAME, BLANK: GAP},
        GAP: {BLANK: GAP, QUOTE: QUOTED, OTHER: BARE},
        QUOTED: {SEMICOLON: QUOTED, BLANK: QUOTED, OTHER: QUOTED, QUOTE: DONE},
        BARE: {OTHER: BARE, BLANK: DONE, SEMICOLON: NEXT},
        DONE: {BLANK: DONE, SEMICOLON: NEXT},
    }[state].get(kind)


def _insertions() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Cheapest insertions that lead from one state to another, and what they insert."""
    cost = np.full((STATES, STATES), FAR, dtype=np.int64)
    what: dict[tuple[int, int], tuple[int, ...]] = {}
    for start in range(STATES):
        heap: list[tuple[int, int, tuple[int, ...]]] = [(0, start, ())]
        while heap:
            c, s, kinds = heapq.heappop(heap)
            if c >= cost[start, s]:
                continue
            cost[start, s], what[start, s] = c, kinds
            for kind in NAMES:
                if (t := _step(s, kind)) is not None:
                    heapq.heappush(heap, (c + (MISSING if kind == OTHER else 1), t, (*kinds, kind)))
    return cost, what


INSERT_COST, INSERTED = _insertions()


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """By kind of character: cost from state to state, and the state from which it was consumed (-1: deleted)."""
    cost = np.full((5, STATES, STATES), FAR, dtype=np.int64)
    via = np.full((5, STATES, STATES), -1, dtype=np.int8)
    for kind in range(5):
        for s in range(STATES):
            if kind != OTHER:
                cost[kind, s, s] = 1
            for middle in range(STATES):
                t = _step(middle, kind)
                if t is not None and INSERT_COST[s, middle] < cost[kind, s, t]:
                    cost[kind, s, t], via[kind, s, t] = INSERT_COST[s, middle], middle
    return cost, via


MOVE_COST, MOVE_VIA = _moves()


#: Cells of back pointers, characters times states, that a batch of lines may hold.
BATCH_CELLS = 1 << 24
#: Costs and the state they come from in one number: of equal costs the lowest state counts.
_FROM = 16
_MOVE = [np.ascontiguousarray(MOVE_COST[:, s] * _FROM).astype(np.int32) for s in range(STATES)]  # by state: kind, next state
_KINDS = np.full(128, OTHER, np.int8)
for _c, _kind in CLASS_OF.items():
    _KINDS[ord(_c)] = _kind
_END_COST = np.array([min(INSERT_COST[s, a] for a in ACCEPTING) for s in range(STATES)])
_END_STATE = [min(ACCEPTING, key=lambda a: INSERT_COST[s, a]) for s in range(STATES)]


def _kinds(lines: list[str]) -> np.ndarray:
    """Kinds of the characters, lines by places; what is behind the end of a line does not matter."""
    width = max(map(len, lines))
    points = np.frombuffer("".join(x.ljust(width, "a") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _KINDS[np.minimum(points, 127)], OTHER).reshape(len(lines), width)


def _edits_of_batch(lines: list[str]) -> list[list[str]]:
    """``cheapest_edits`` of lines in descending order of length: one step of the programme for all lines at once."""
    kinds, lengths = _kinds(lines), np.array([len(x) for x in lines])
    width = kinds.shape[1]
    open_at = np.searchsorted(-lengths, -np.arange(width), side="left")  # lines longer than a place
    states = np.arange(STATES, dtype=np.int32)
    cost = np.full((len(lines), STATES), FAR * _FROM, np.int32) + states
    cost[:, 0] = 0
    back = np.zeros((width, len(lines), STATES), np.int8)
    for i in range(width):
        n = open_at[i]
        kind, best = kinds[:n, i], np.full((n, STATES), FAR * _FROM * 2, np.int32)
        for s in range(STATES):
            np.minimum(best, _MOVE[s].take(kind, axis=0) + cost[:n, s : s + 1], out=best)
        back[i, :n] = best % _FROM
        cost[:n] = np.minimum(best - best % _FROM, FAR * _FROM) + states
    state = (cost // _FROM + _END_COST).argmin(axis=1)
    edits: list[list[str]] = [[f"insert {NAMES[k]} at end" for k in reversed(INSERTED[int(s), _END_STATE[s]])] for s in state]
    for i in range(width - 1, -1, -1):
        n = open_at[i]
        rows = np.arange(n)
        before, kind = back[i, rows, state[:n]], kinds[:n, i]
        middle = MOVE_VIA[kind, before, state[:n]]
        for r in np.flatnonzero((middle < 0) | (INSERT_COST[before, middle] > 0)):
            if middle[r] < 0:
                edits[r].append(f"delete {NAMES[int(kind[r])]} at {i + 1}")
            else:
                edits[r] += [f"insert {NAMES[k]} at {i + 1}" for k in reversed(INSERTED[int(before[r]), int(middle[r])])]
        state[:n] = before
    return [x[::-1] for x in edits]


def cheapest_edits_of(lines: list[str]) -> list[list[str]]:
    """The edits of least total cost that make each line follow the grammar; none if it does."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    found: list[list[str]] = [[] for _ in lines]
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, BATCH_CELLS // (STATES * max(1, len(lines[order[at]])))))
        some = order[at : at + n]
        if lines[some[0]]:
            for i, edits in zip(some, _edits_of_batch([lines[i] for i in some])):
                found[i] = edits
        else:  # nothing but empty lines is left
            for i in some:
                found[i] = [f"insert {NAMES[k]} at end" for k in INSERTED[0, _END_STATE[0]]]
        at += n
    return found


def cheapest_edits(line: str) -> list[str]:
    """``cheapest_edits_of`` one line."""
    return cheapest_edits_of([line])[0]


def type_errors(line: str) -> list[str]:
    """What is wrong with the values of a line that follows the grammar."""
    f = line.split("\t")
    found = []
    digits = re.compile(r"[0-9]{1,18}")
    numbers = {n: int(f[n - 1]) for n in (4, 5) if digits.fullmatch(f[n - 1])}
    for n in (4, 5):
        if n not in numbers:
            found.append(f"field {n} is no number of 1 to 18 digits")
        elif numbers[n] < 1:
            found.append(f"field {n} is below 1")
    if len(numbers) == 2 and numbers[4] > numbers[5]:
        found.append("field 4 is above field 5")
    if f[6] not in ("+", "-", "."):
        found.append("field 7 is no strand")
    for name, value in re.findall(r' *([^ ;"\t]+) +("[^"]*"|[^ ;"\t]+) *;?', f[8]):
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            found.append(f"attribute name {name!r}")
        if value[0] != '"' and not re.fullmatch("[0-9]+", value):
            found.append(f"bare value of {name!r} is no number")
    return found


def gtf_reasons(lines: list[str | None]) -> list[str | None]:
    """Why each line is no record; None if it is one."""
    held = [x for x in lines if x is not None]
    edits = iter(cheapest_edits_of(held))
    return ["null" if x is None else "; ".join(next(edits) or type_errors(x)) or None for x in lines]


def gtf_reason(line: str | None) -> str | None:
    """``gtf_reasons`` of one line."""
    return gtf_reasons([line])[0]


#: Characters of a record that may be deleted as stray quotes or delimiters.
STRAY = re.compile(r"""["'“”‘’;:,.|\-_ \t>]""")
LETTERS = f"{SYMBOLS}{SYMBOLS.lower()}"
TOKEN = re.compile(rf"(?s)>|(?<![{LETTERS}])[{LETTERS}]|[{LETTERS}]+|(.)\1*")

# States of a record: before '>', after it, in the header, after the header's line, after a symbol of the sequence.
OPEN, MARKED, HEADER, BARREN, SEQUENCE = range(5)


def _fasta_step(state: int, token: str) -> tuple[int, int, str] | None:
    """The state after a run of one kind of character, its cost and the edit; None if there is no way."""
    if token == "\n":
        return None if state == MARKED else (BARREN if state == HEADER else state, 0, "")
    if state == HEADER or (state == MARKED and token[0] not in " \t"):
        return HEADER, 0, ""
    if state == MARKED:
        return MARKED, len(token), "blank"
    if state == OPEN:
        return (MARKED, 0, "") if token == ">" else (OPEN, len(token), "delete") if STRAY.match(token) else None
    if token[0] in LETTERS:
        return SEQUENCE, 0, ""
    return (state, len(token), "delete") if STRAY.match(token) else (SEQUENCE, MISSING * len(token), "symbol")


def fasta_edits(lines: list[tuple[int, str]]) -> list[tuple[str, int, int, str]]:
    """The edits of least total cost, ``(edit, line, place, characters)``, that make numbered lines a record; none if they are one.

    A programme over runs of characters and the states of a record. A stray delimiter is deleted, and a
    header mark, line break or record break inserted, at a cost of one; a wrong symbol, and a header or
    sequence that is missing altogether, costs ``MISSING``. Lines are as they stand: no break is deleted.
    """
    best: dict[int, tuple[int, tuple | None]] = {OPEN: (0, None)}  # by state: cost, and the edits as (earlier ones, last)

    def reach(into: dict, state: int, cost: int, edits: tuple | None) -> None:
        if state not in into or cost < into[state][0]:
            into[state] = cost, edits

    def insert(start: int, state: int, cost: int, *edit) -> None:
        if start in best:
            reach(best, state, best[start][0] + cost, (best[start][1], edit))

    for k, (n, s) in enumerate(lines):
        tokens = [(m.start() + 1, m.group()) for m in TOKEN.finditer(s)]
        for i, token in [(1, "\n")] * bool(k) + tokens:
            if token != ">":
                insert(OPEN, MARKED, 1, "mark", n, i, "")
            insert(MARKED, HEADER, MISSING, "empty header", n, i, "")
            insert(HEADER, BARREN, 1, "line break", n, i, "")
            insert(BARREN, SEQUENCE, MISSING, "empty sequence", n, i, "")
            if token == ">":
                insert(SEQUENCE, OPEN, 1, "record break", n, i, "")
            after: dict[int, tuple[int, tuple | None]] = {}
            for state in (OPEN, MARKED, HEADER, SEQUENCE, BARREN):  # of equal costs the first counts: a break as early as may be
                if state in best and (step := _fasta_step(state, token)):
                    cost, edits = best[state]
                    reach(after, step[0], cost + step[1], (edits, (step[2], n, i, token)) if step[2] else edits)
            best = after
    at = (lines[-1][0], len(lines[-1][1]) + 1)
    insert(OPEN, MARKED, 1, "mark", *at, "")
    insert(MARKED, HEADER, MISSING, "empty header", *at, "")
    insert(HEADER, SEQUENCE, MISSING, "empty sequence", *at, "")
    insert(BARREN, SEQUENCE, MISSING, "empty sequence", *at, "")
    found, edits = [], best[SEQUENCE][1]
    while edits:
        edits, last = edits
        found.append(last)
    return found[::-1]


def _fasta_words(edits: list[tuple[str, int, int, str]]) -> list[str]:
    """Edits in words; all places of one deletion or wrong symbol stand together, neighbours as a run."""
    places: dict[tuple[str, str], list[list[int]]] = {}  # runs: line, first and last place
    for edit, n, i, token in edits:
        runs = places.setdefault((edit, token[0]) if edit in ("delete", "symbol") else (edit, f"{n}:{i}"), [])
        if runs and token and runs[-1][0] == n and runs[-1][2] == i - 1:
            runs[-1][2] = i + len(token) - 1
        else:
            runs.append([n, i, i + max(len(token), 1) - 1])
    found = []
    for (edit, c), runs in places.items():
        n, i, _ = runs[0]
        where = f"line {n}" if i == 1 else f"line {n}:{i}"
        found.append({
            "mark": f"insert '>' at {where}", "blank": f"delete blank after '>' at line {n}",
            "line break": f"insert line break at {where}", "record break": f"insert record break before {where}",
            "empty header": edit, "empty sequence": edit,
        }.get(edit) or f"{edit} {c!r} at line " + ", ".join(f"{n}:{i}" if i == j else f"{n}:{i}-{j}" for n, i, j in runs))
    return found


def fasta_reason(record: str | None) -> str | None:
    """Why ``record`` is no transcript; None if it is one."""
    if record is None:
        return "null"
    lines = [(n, s) for n, s in enumerate((x.strip(" \t\r") for x in record.split("\n")), 1) if s]
    if not lines:
        return "empty"
    return "; ".join(_fasta_words(fasta_edits(lines))) or None


#: Reason of a row that the pattern refuses although the programme would not; no row is known to be one.
REFUSED = "refused by the pattern of a record"


def fasta_reasons(records: list[str | None]) -> list[str | None]:
    """``fasta_reason`` of many records."""
    return [fasta_reason(x) for x in records]


def _with_reason(rows: DataFrame, key: str, text: str, reasons_of) -> DataFrame:
    """``(key, reason)`` of rows that are no records, so that every row is either loaded or has a reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = pa.array([x or REFUSED for x in reasons_of(batch.column(1).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), reasons], names=[key, "reason"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, reason string")


def _gtf_fields(line: Column) -> tuple[Column, Column]:
    """The fields of a line, and whether it is well formed with the right types."""
    f = F.split(line, "\t", -1)
    at = lambda n: F.get(f, n - 1)
    number = lambda n: at(n).try_cast("long")
    good = (
        (F.size(f) == 9) & at(4).rlike(DIGITS) & at(5).rlike(DIGITS) & at(7).isin("+", "-", ".") & at(9).rlike(ATTRIBUTES)
        & (number(4) >= 1) & (number(4) <= number(5))
    )
    return f, F.coalesce(good, F.lit(False))


def skipped(line: Column) -> Column:
    """Comments and blank lines of an annotation file."""
    return F.coalesce(line.startswith("#") | line.rlike(r"\A[ \t]*+\z"), F.lit(False))


def load_gtf(df: DataFrame, *, key: str = "raw_id", line: str = "line", loaded_at: str = "loaded_at") -> tuple[DataFrame, DataFrame]:
    """``(records, failures)`` of raw annotation lines: the columns of gtf_records, and (raw_id, reason)."""
    rows = df.select(F.col(key).alias("raw_id"), F.col(line).alias("line"), F.col(loaded_at).alias("loaded_at"))
    rows = rows.where(~skipped(F.col("line")))
    fields, good = _gtf_fields(F.col("line"))
    f = lambda n: F.get("f", n - 1)
    attributes = last_wins_map(
        F.regexp_extract_all(f(9), F.lit(PAIRS), F.lit(1)),
        F.zip_with(F.regexp_extract_all(f(9), F.lit(PAIRS), F.lit(2)), F.regexp_extract_all(f(9), F.lit(PAIRS), F.lit(3)), lambda a, b: F.concat(a, b)),
    )
    records = rows.where(good).withColumn("f", fields).select(
        F.col("raw_id").alias("rec_id"), f(1).alias("seqname"), f(3).alias("feature"), f(4).cast("long").alias("start_pos"),
        f(5).cast("long").alias("stop_pos"), f(7).alias("strand"), attributes.alias("attrs"), "loaded_at",
        F.lit(None).cast(rows.schema["loaded_at"].dataType).alias("deleted_at"),
    )
    return records, _with_reason(rows.where(~good), "raw_id", "line", gtf_reasons).distinct()


def load_fasta(df: DataFrame, *, key: str = "raw_id", record: str = "record", loaded_at: str = "loaded_at") -> tuple[DataFrame, DataFrame]:
    """``(records, failures)`` of raw transcript records: the columns of fasta_records, and (raw_id, reason)."""
    rows = df.select(F.col(key).alias("raw_id"), F.col(record).alias("record"), F.col(loaded_at).alias("loaded_at"))
    lines = F.filter(F.transform(F.split("record", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    head, sequence = F.get("lines", 0), F.array_join(F.slice("lines", 2, 1 << 30), "")
    good = F.coalesce(head.rlike(r"\A>[^ \t]") & sequence.rlike(rf"\A[{SYMBOLS}{SYMBOLS.lower()}]++\z"), F.lit(False))
    rows = rows.withColumn("lines", lines)
    records = rows.where(good).select(
        F.col("raw_id").alias("rec_id"), F.substring(head, 2, 1 << 30).alias("header"), sequence.alias("sequence"), "loaded_at"
    )
    return records, _with_reason(rows.where(~good), "raw_id", "record", fasta_reasons).distinct()
