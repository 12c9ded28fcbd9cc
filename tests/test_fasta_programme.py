"""Minimum-cost parsing of raw transcript records."""

import itertools
import re

import pytest

from kmerloom.operators import error_parse as E


def valid(record):
    lines = [x for x in (x.strip(" \t\r") for x in record.split("\n")) if x]
    return bool(lines) and bool(re.match(r">[^ \t]", lines[0])) and bool(re.fullmatch("[ACGTURYSWKMBDHVNacgturyswkmbdhvn]+", "".join(lines[1:])))


def test_agrees_with_the_grammar():
    for n in range(7):
        for x in itertools.product(">\nAZ. ", repeat=n):
            record = "".join(x)
            assert (E.fasta_reason(record) is None) == valid(record), record


@pytest.mark.parametrize("record, reason", [
    (">T\nAC\n>", "delete '>' at line 3:1"),
    (">T\nAC\n>GT", "delete '>' at line 3:1"),
    (">T1\nAC\n>T10\nGG", "insert record break before line 3"),
    (">T1 ACGT", "insert line break at line 1:5"),
    ('">T1\nAC', "delete '\"' at line 1:1"),
    (">", "empty header; empty sequence"),
])
def test_least_cost(record, reason):
    """Edits chosen together: one each, where edits chosen apart leave the record broken or are more."""
    assert E.fasta_reason(record) == reason
