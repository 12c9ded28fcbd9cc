"""Column builders for reads, translation, k-mers and packed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AA28, BITS_PER_RESIDUE, CODON64, MAX_RESIDUES


def residues_of(k: int) -> int:
    """Residues of a DNA k-mer; k must be a multiple of three and the packed key must fit a BIGINT."""
    if k < 3 or k % 3:
        raise ValueError("k must be a positive multiple of 3")
    if k // 3 > MAX_RESIDUES:
        raise ValueError(f"at most {MAX_RESIDUES} residues fit a packed key")
    return k // 3


def to_dna(seq: Column) -> Column:
    """Upper case, U read as T."""
    return F.translate(F.upper(seq), "U", "T")


def usable_read(seq: Column, k: int) -> Column:
    """Reads without N or other ambiguity codes, at least ``k`` long."""
    return F.coalesce((F.length(seq) >= k) & seq.rlike(r"\A[ACGTacgtUu]++\z"), F.lit(False))


def unencodable_read(seq: Column, k: int) -> Column:
    """Reads that are long enough and without N but hold other symbols; they are dropped, and can be counted."""
    return F.coalesce((F.length(seq) >= k) & ~seq.rlike("[Nn]") & ~seq.rlike(r"\A[ACGTacgtUu]++\z"), F.lit(False))


def twobit(base: Column) -> Column:
    """Code of a nucleotide: A0 C1 G2 T3."""
    return F.position(base, F.lit("ACGT")) - 1


def translate_frame(dna: Column, frame: int, code: str = CODON64) -> Column:
    """Peptide of the codons from ``frame`` (0, 1 or 2) on; a trailing partial codon is ignored.

    The codons are cut out by one regular expression and each is one lookup in a literal map, so a
    read is translated once per frame and not once per window.
    """
    if len(code) != 64:
        raise ValueError("a genetic code has 64 letters")
    bases = "ACGT"
    pairs = [x for i, aa in enumerate(code) for x in (F.lit(bases[i >> 4] + bases[i >> 2 & 3] + bases[i & 3]), F.lit(aa))]
    codons = F.regexp_extract_all(F.substring(dna, frame + 1, 1 << 30), F.lit("..."), F.lit(0))
    table = F.create_map(*pairs)
    return F.array_join(F.transform(codons, lambda c: table[c]), "")


def windows(text: Column, length: int) -> Column:
    """Array of (at, kmer) of all overlapping windows, 0-based; empty where the text is shorter."""
    starts = F.sequence(F.lit(0), F.length(text) - length)
    return F.when(F.length(text) >= length, F.transform(starts, lambda i: F.struct(i.alias("at"), F.substr(text, i + 1, F.lit(length)).alias("kmer"))))


def kmerize_dna(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """One row (keep.., at, kmer) per DNA window of ``k`` bases; shorter reads give none."""
    return df.select(*keep, F.explode(windows(F.col(seq), k)).alias("w")).select(*keep, "w.at", "w.kmer")


def kmerize_peptide(df: DataFrame, seq: str, residues: int, *keep: str) -> DataFrame:
    """One row (keep.., at, kmer) per window of a peptide."""
    return kmerize_dna(df, seq, residues, *keep)


def translated_kmers(df: DataFrame, seq: str, k: int, *keep: str, code: str = CODON64) -> DataFrame:
    """Peptide k-mers (keep.., kmer) of all DNA windows of ``k`` bases, those with a stop codon dropped.

    A window that starts at base s is the window of the frame s mod 3, so translating the three
    frames once gives the same k-mers as translating every window.
    """
    n = residues_of(k)
    frames = F.array(*[translate_frame(to_dna(F.col(seq)), f, code) for f in range(3)])
    # Only stop-free stretches can hold k-mers: cut them out before exploding.
    stretches = F.flatten(F.transform(frames, lambda p: F.filter(F.split(p, r"\*", -1), lambda s: F.length(s) >= n)))
    cut = df.where(usable_read(F.col(seq), k)).select(*keep, F.explode(stretches).alias("__s"))
    starts = F.sequence(F.lit(1), F.length("__s") - (n - 1))
    return cut.select(*keep, "__s", F.explode(starts).alias("__i")).select(*keep, F.substr(F.col("__s"), F.col("__i"), F.lit(n)).alias("kmer"))


def encode5(residue: Column) -> Column:
    """5-bit code of a residue, null for a symbol outside the alphabet."""
    at = F.position(residue, F.lit(AA28))
    return F.when((at > 0) & (residue != ""), at - 1)


def decode5(code: Column) -> Column:
    """Residue of a 5-bit code, null outside the alphabet."""
    return F.when((code >= 0) & (code < len(AA28)), F.substr(F.lit(AA28), code.cast("int") + 1, F.lit(1)))


#: The digits of base 32 that stand for the residues' codes.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"[: len(AA28)]


def pack(kmer: Column, residues: int) -> Column:
    """Key of a k-mer of ``residues`` residues: 5 bits each, the first one most significant.

    Read as digits of base 32, the codes are the number itself. Null for other lengths or symbols.
    """
    if not 0 < residues <= MAX_RESIDUES:
        raise ValueError(f"between 1 and {MAX_RESIDUES} residues fit a packed key")
    known = (F.length(kmer) == residues) & (F.translate(kmer, AA28, "") == "")
    return F.when(known, F.conv(F.translate(kmer, AA28, _DIGITS), 32, 10).cast("long"))


def residue_code(bits: Column, i: int, residues: int) -> Column:
    """Code of residue ``i`` (1-based) of a packed key."""
    return F.shiftrightunsigned(bits, BITS_PER_RESIDUE * (residues - i)).bitwiseAND(F.lit(31))


def unpack(bits: Column, residues: int) -> Column:
    """The k-mer of a packed key; null for one that holds codes outside the alphabet or further bits.

    Two residues at a time are looked up in an array made from the alphabet.
    """
    known = [*AA28, *[None] * ((1 << BITS_PER_RESIDUE) - len(AA28))]
    pairs = F.array(*[F.lit(a + b if a and b else None) for a in known for b in known])
    width = 2 * BITS_PER_RESIDUE
    at = lambda i: F.shiftright(bits, width * i).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    parts = [F.get(pairs, at(i)) for i in reversed(range(residues // 2))]
    if residues % 2:
        parts.insert(0, decode5(F.shiftright(bits, width * (residues // 2))))
    fits = (bits >= 0) & (bits < F.lit(1 << (BITS_PER_RESIDUE * residues)))
    return F.when(fits, F.concat(*parts))


def binary_string(bits: Column) -> Column:
    """All 64 bits of a key as text."""
    return F.lpad(F.bin(bits), 64, "0")


def geometry(residues: int, i: int) -> dict[str, int]:
    """Where residue ``i`` of a key lies in words of 64 bits: word, shift and whether it straddles two words."""
    bits = BITS_PER_RESIDUE * residues
    words = -(-bits // 64)
    low = BITS_PER_RESIDUE * (residues - i)
    return {"words": words, "offset": 64 * words - bits, "word": words - 1 - low // 64, "shift": low % 64, "straddles": int(low % 64 > 64 - BITS_PER_RESIDUE)}
