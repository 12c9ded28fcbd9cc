"""Reasons name every edit and whole names."""

from kmerloom.operators import error_parse as E


def test_every_edit_of_a_record():
    record = ">T\n" + "Z" * 60 + "A.C.\n" + "ZA" * 40
    odd = ", ".join(f"3:{i}" for i in range(1, 80, 2))
    assert E.fasta_reason(record) == f"symbol 'Z' at line 2:1-60, {odd}; delete '.' at line 2:62, 2:64"
    assert E.fasta_reason(">T\n" + "\n".join(["AJ"] * 200)).endswith(", 200:2, 201:2")


def test_whole_names():
    name = "9" + "x" * 100
    line = f"c1\tsrc\texon\t1\t20\t.\t+\t0\t{name} x"
    assert E.gtf_reason(line) == f"attribute name {name!r}; bare value of {name!r} is no number"
