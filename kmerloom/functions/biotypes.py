"""Column builders for biotype masks: bit b-1 of a mask is the b-th name, the first being ``intergenic``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import INTERGENIC_MASK, MAX_BIOTYPES


def bit_of(position: Column) -> Column:
    """Mask of the name at a 1-based position; 0 beyond the 64th, 1 for a null (unknown) position."""
    bits = F.expr("array(" + ", ".join(f"shiftleft(1L, {i})" for i in range(MAX_BIOTYPES)) + ")")
    return F.when(position.isNull(), F.lit(INTERGENIC_MASK).cast("long")).when(position.between(1, MAX_BIOTYPES), F.get(bits, position.cast("int") - 1)).otherwise(F.lit(0).cast("long"))


def mask_names(mask: Column, names: list[str]) -> Column:
    """Names of the set bits, in ascending order of bits."""
    if len(names) > MAX_BIOTYPES:
        raise ValueError(f"a mask holds at most {MAX_BIOTYPES} biotypes")
    named = F.array(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names)])
    return F.filter(named, lambda x: x.isNotNull())


def has_biotype(mask: Column, name: str, names: list[str]) -> Column:
    """Whether the mask has the bit of ``name``; an unknown name is an error."""
    if name not in names:
        raise ValueError(f"unknown biotype {name!r}")
    return F.getbit(mask, F.lit(names.index(name))) == 1


def header_biotype(header: Column) -> Column:
    """Biotype named by a transcript header, or null."""
    return F.nullif(F.regexp_extract(header, r"transcript_biotype:(\S+)", 1), F.lit(""))


def header_transcript(header: Column) -> Column:
    """Transcript id of a header: its first token, without version."""
    return F.substring_index(F.substring_index(header, " ", 1), ".", 1)


def plain_transcript_id(identifier: Column) -> Column:
    """A GFF3 id without its type prefix."""
    return F.regexp_replace(identifier, "^transcript:", "")
