"""The k-mer table: keys, per-sample counts and biotype masks as DataFrames.

Counts are kept in long form, one row per key and sample with a positive count. A count that is not
there is zero, so adding a sample appends its rows and never rewrites older ones; vectors are made
on demand. Masks have one row per key; a key without one is intergenic.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import BIOTYPE_LAYER, BITS_PER_RESIDUE, COUNTS_LAYER, INTERGENIC, INTERGENIC_MASK, MAX_RESIDUES, SUFFIX_RESIDUES
from ..durable import materialise
from ..functions import biotypes
from ..functions.kmers import unpack
from .positions import at_positions, between_positions, with_position

COUNTS = "kmer_bits bigint, sample_idx int, cnt bigint"
MASKS = "kmer_bits bigint, biotype_mask bigint"


def prefix(bits: Column | str, suffix_residues: int = SUFFIX_RESIDUES) -> Column:
    """A key without its last residues."""
    return F.shiftright(bits, BITS_PER_RESIDUE * suffix_residues)


def count_vector(counts: DataFrame, samples: int) -> DataFrame:
    """``(kmer_bits, counts)``: one array of ``samples`` entries per key, zeros where a sample lacks it.

    ``counts`` has at most one row per key and sample, with samples from 1 on. The few entries of a
    key are put in order and the zeros between them repeated, so the work follows what a key holds.
    """
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    held = counts.groupBy("kmer_bits").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "cnt"))).alias("e"))
    before = lambda i: F.coalesce(F.get("e", i - 1)["sample_idx"], F.lit(0))
    parts = F.transform("e", lambda x, i: F.concat(zeros(x["sample_idx"] - before(i) - 1), F.array(x["cnt"])))
    return held.select("kmer_bits", F.concat(F.flatten(parts), zeros(F.lit(samples) - F.element_at("e", -1)["sample_idx"])).alias("counts"))


def unpack_words(words: Column, n_words: Column, samples: Column, per_word: int = 4) -> Column:
    """Count vector of packed words (``per_word`` counts each, the first in the low bits), cut or zero-padded to ``samples``."""
    width = 64 // per_word
    used = F.slice(words, 1, F.greatest(F.coalesce(n_words.cast("int"), F.lit(0)), F.lit(0)))
    mask = (1 << width) - 1
    split = lambda w: F.array(*[F.shiftrightunsigned(F.coalesce(w, F.lit(0).cast("long")), width * i).bitwiseAND(F.lit(mask)) for i in range(per_word)])
    flat = F.flatten(F.transform(F.coalesce(used, F.array().cast("array<bigint>")), split))
    n = F.greatest(F.coalesce(samples.cast("int"), F.lit(0)), F.lit(0))
    return F.slice(F.concat(flat, F.array_repeat(F.lit(0).cast("long"), n)), F.lit(1), n)


def push_vector(old: DataFrame, new: DataFrame, samples: int) -> DataFrame:
    """Full-outer upsert in wide form: vectors of ``samples`` entries get one more; new keys get zeros before it."""
    before = F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), samples))
    return old.join(new, "kmer_bits", "full_outer").select("kmer_bits", F.concat(before, F.array(F.coalesce("cnt", F.lit(0).cast("long")))).alias("counts"))


@dataclass(frozen=True)
class KmerTable:
    residues: int
    counts: DataFrame | None = None
    masks: DataFrame | None = None
    samples: int = 0
    names: list[str] = field(default_factory=lambda: [INTERGENIC])
    bare: DataFrame | None = None  # keys of a table without layers
    stored_positions: DataFrame | None = None  # (kmer_bits, pos) that were written with the table
    _made: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        if not 0 < self.residues <= MAX_RESIDUES:
            raise ValueError(f"between 1 and {MAX_RESIDUES} residues fit a packed key")

    # construction

    @classmethod
    def empty(cls, spark: SparkSession, residues: int) -> KmerTable:
        return cls(residues, counts=spark.createDataFrame([], COUNTS))

    @classmethod
    def from_counts(cls, df: DataFrame, residues: int) -> KmerTable:
        """Table of one sample, from ``(kmer_bits, cnt)``."""
        return cls.empty(df.sparkSession, residues).push(df)

    @classmethod
    def from_samples(cls, counts: DataFrame, residues: int, samples: int) -> KmerTable:
        """Table of many samples at once, from ``(kmer_bits, sample_idx, cnt)`` with 1-based samples."""
        return cls(residues, counts=counts.select("kmer_bits", F.col("sample_idx").cast("int").alias("sample_idx"), "cnt").where("cnt > 0"), samples=samples)

    @classmethod
    def from_masks(cls, masks: DataFrame, residues: int, names: list[str]) -> KmerTable:
        """A genomic index, from ``(kmer_bits, biotype_mask)``."""
        if not names or names[0] != INTERGENIC:
            raise ValueError(f"the first biotype must be {INTERGENIC!r}")
        return cls(residues, masks=masks.select("kmer_bits", "biotype_mask"), names=list(names))

    # shape

    @property
    def layers_mask(self) -> int:
        return COUNTS_LAYER * (self.counts is not None) + BIOTYPE_LAYER * (self.masks is not None)

    @property
    def keys(self) -> DataFrame:
        if self.counts is not None:
            return self.counts.select("kmer_bits").distinct()
        return (self.masks if self.masks is not None else self.bare).select("kmer_bits")

    def length(self) -> int:
        return self.keys.count()

    @property
    def positions(self) -> DataFrame:
        """``(kmer_bits, pos)``, sorted by key within range-partitioned files: made once for the table, or read where it was stored.

        The files' statistics let a lookup of one key, or of a prefix, read only the row groups that can hold it.
        """
        if self.stored_positions is not None:
            return self.stored_positions
        if "positions" not in self._made:
            self._made["positions"] = with_position(self.keys, "kmer_bits")
        return self._made["positions"]

    # change

    def push(self, sample: DataFrame) -> KmerTable:
        """The table with one more sample, ``(kmer_bits, cnt)``; keys new to an annotated table are intergenic."""
        if self.counts is None and (self.masks is not None or self.bare is not None):
            raise ValueError("a table without counts takes no samples")
        n = self.samples + 1
        new = sample.where("cnt > 0").select("kmer_bits", F.lit(n).alias("sample_idx"), F.col("cnt").cast("long").alias("cnt"))
        return replace(self, counts=new if self.counts is None else self.counts.unionByName(new), samples=n, stored_positions=None)

    def add_biotypes(self, index: KmerTable) -> KmerTable:
        """Left join with a genomic index: keys it lacks are intergenic; its names are kept."""
        if self.counts is None or self.masks is not None or index.masks is None:
            raise ValueError("a table with counts and without biotypes takes a genomic index")
        if self.residues != index.residues:
            raise ValueError("tables of different k")
        masks = self.keys.join(index.masks, "kmer_bits", "left").fillna({"biotype_mask": INTERGENIC_MASK})
        return replace(self, masks=masks, names=index.names)

    # projections

    def wide(self) -> DataFrame:
        """``(kmer_bits[, counts][, biotype_mask])``, one row per key."""
        if self.counts is None:
            return self.masks if self.masks is not None else self.keys
        rows = count_vector(self.counts, self.samples)
        return rows if self.masks is None else rows.join(self.masks, "kmer_bits", "left").fillna({"biotype_mask": INTERGENIC_MASK})

    def _of(self, placed: DataFrame) -> DataFrame:
        """The layers of the placed keys ``(kmer_bits, pos)``; vectors are made of these keys only."""
        rows = placed
        if self.counts is not None:
            wanted = self.counts.join(placed.select("kmer_bits"), "kmer_bits", "left_semi")
            rows = rows.join(count_vector(wanted, self.samples), "kmer_bits")
        if self.masks is not None:
            rows = rows.join(self.masks, "kmer_bits", "left").fillna({"biotype_mask": INTERGENIC_MASK})
        return rows.withColumn("kmer", unpack(F.col("kmer_bits"), self.residues))

    def rows(self) -> DataFrame:
        """``wide`` with the position and the text of every key."""
        return with_position(self.wide(), "kmer_bits").withColumn("kmer", unpack(F.col("kmer_bits"), self.residues))

    def at(self, position: int) -> DataFrame:
        return self.slice(position, position)

    def slice(self, first: int, last: int) -> DataFrame:
        """Rows at positions ``first`` to ``last``; only keys are sorted and placed."""
        return self._of(materialise(between_positions(self.positions, first, last), "placed"))

    def take(self, positions: list[int]) -> DataFrame:
        """Rows at the given positions, in their order and as often as they are named: adds ``ordinal``."""
        placed = self.positions.where(F.col("pos").isin(sorted(set(positions))))
        return at_positions(self._of(materialise(placed, "placed")), positions)

    def lookup(self, probes: DataFrame) -> DataFrame:
        """``probes`` (kmer_bits) with ``pos``, 0 where the table lacks the key. The keys are unique, so no probe is repeated."""
        return probes.join(self.positions, "kmer_bits", "left").fillna({"pos": 0})

    def find(self, bits: int) -> int:
        """Position of one key, or 0: the key is pushed down to the sorted positions."""
        row = self.positions.where(F.col("kmer_bits") == bits).select("pos").first()
        return row[0] if row else 0

    def find_all(self, keys: list[int]) -> dict[int, int]:
        """Positions of a few keys, 0 for those the table lacks, by one pruned scan."""
        rows = self.positions.where(F.col("kmer_bits").isin(sorted(set(keys)))).collect()
        return dict.fromkeys(keys, 0) | {r.kmer_bits: r.pos for r in rows}

    def with_prefix(self, value: int, suffix_residues: int = SUFFIX_RESIDUES) -> DataFrame:
        """``(kmer_bits, pos)`` of the keys behind one prefix, read from their range of the positions."""
        low = value << (BITS_PER_RESIDUE * suffix_residues)
        return self.positions.where(F.col("kmer_bits").between(low, low + (1 << (BITS_PER_RESIDUE * suffix_residues)) - 1)).select("kmer_bits", "pos")

    def prefix_index(self, suffix_residues: int = SUFFIX_RESIDUES) -> DataFrame:
        """``(prefix, first_pos, last_pos)`` of the keys that share a prefix."""
        return self.positions.groupBy(prefix("kmer_bits", suffix_residues).alias("prefix")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))

    # vectors as a dictionary

    def collapse(self) -> tuple[DataFrame, DataFrame]:
        """``(vector_id, counts, n_keys)`` of the distinct vectors, ids in their order, and ``(kmer_bits, vector_id)``.

        Vectors are built once; keys find theirs by two hashes of 64 bits, and the vectors are compared only where these agree.
        """
        if self.counts is None:
            raise ValueError("a table without counts has no vectors")
        hashes = [F.xxhash64("counts").alias("h1"), F.xxhash64("counts", F.lit(1)).alias("h2")]
        rows = materialise(count_vector(self.counts, self.samples).select("kmer_bits", "counts", *hashes), "vectors")
        distinct = rows.groupBy("counts").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.count(F.lit(1)).alias("n_keys"))
        dictionary = materialise(with_position(distinct, "counts", name="vector_id"), "dictionary")
        ids = dictionary.select("h1", "h2", F.col("counts").alias("__of"), "vector_id")
        same = (rows["h1"] == ids["h1"]) & (rows["h2"] == ids["h2"]) & (rows["counts"] == ids["__of"])
        return dictionary.select("vector_id", "counts", "n_keys"), rows.join(ids, same).select("kmer_bits", "vector_id")

    def shared_vectors(self) -> DataFrame:
        """``(counts, n_keys)`` of the vectors that more than one key has."""
        return count_vector(self.counts, self.samples).groupBy("counts").agg(F.count(F.lit(1)).alias("n_keys")).where("n_keys > 1")

    # biotypes

    def biotype_names(self) -> DataFrame:
        return self.masks.withColumn("names", biotypes.mask_names(F.col("biotype_mask"), self.names))

    def having(self, name: str) -> DataFrame:
        return self.masks.where(biotypes.has_biotype(F.col("biotype_mask"), name, self.names))

    def mask_pool(self) -> DataFrame:
        """``(mask_id, biotype_mask, n_keys)`` of the distinct masks."""
        pool = self.masks.groupBy("biotype_mask").agg(F.count(F.lit(1)).alias("n_keys"))
        return with_position(pool, "biotype_mask", name="mask_id")

    def intergenic_tally(self) -> DataFrame:
        return self.masks.agg(F.count_if(F.col("biotype_mask") == INTERGENIC_MASK).alias("n_intergenic"), F.count(F.lit(1)).alias("n_kmers"))
