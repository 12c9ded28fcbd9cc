"""The queries of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import materialise, spread, table, unique_rows
from . import bpe, frequency, heavy, overlap, packing, spans

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("KMERLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
CAPACITY = 2048
SHARED_RUN = 200


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents, a replayed row once."""
    return unique_rows(spread(table(spark, sf_dir, "documents", *columns)), "doc_id")


def p3_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared k-mers of every pair of samples, with the sizes of both sets."""
    rows = table(spark, sf_dir, "sample_counts", "kmer_bits", "sample_idx", "cnt").where("cnt >= 1")
    return overlap.overlaps(rows, "kmer_bits", "sample_idx").select(
        F.col("set_a").alias("sample_a"), F.col("set_b").alias("sample_b"), "shared", "size_a", "size_b"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of samples that share at least half of the smaller set."""
    return p3_overlaps(spark, sf_dir).where("2 * shared >= least(size_a, size_b)").select("sample_a", "sample_b")


def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sample_counts that count, a replayed row once."""
    rows = table(spark, sf_dir, "sample_counts").where("kmer_bits is not null and sample_idx is not null and cnt > 0")
    return rows.distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers with at least 1/500 of all counts."""
    return heavy.most_frequent(counted_rows(spark, sf_dir), "kmer_bits", "cnt", share=1 / 500).select("kmer_bits")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 k-mers with the largest summed counts."""
    rows = table(spark, sf_dir, "sample_counts").where("sample_idx is not null")
    return heavy.most_frequent(rows, "kmer_bits", "cnt", k=100, identity=[c for c in rows.columns if c not in ("kmer_bits", "cnt")])


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, rows and mark of every packed count word."""
    rows = unique_rows(table(spark, sf_dir, "counts_layer"), "kmer_bits")
    return frequency.term_frequencies(rows, "counts", "n_cids").withColumnRenamed("term", "word")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in too few or too many rows to be worth sharing."""
    return p5_words(spark, sf_dir).where("mark is not null").select("word", "mark")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(documents(spark, sf_dir, "doc_id", "text"), BYTE_BPE)


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids decoded again: the hash of the text, its length, and whether there are any ids."""
    ids = p6_ids(spark, sf_dir)
    decoded = bpe.decode_corpus(ids.select("doc_id", "ids"), BYTE_BPE)
    return decoded.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.length("text").alias("n_chars"), (F.col("text") != "").alias("any_ids"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or part of an oversize one, with its container."""
    sizes = bpe.count_corpus(documents(spark, sf_dir, "doc_id", "text"), BYTE_BPE)
    return packing.pack(sizes, CAPACITY)


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the least possible number."""
    return packing.packing_report(p7_containers(spark, sf_dir), CAPACITY)


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document is packed, by the rules, in close to the least number of containers."""
    return packing.packing_checks(materialise(p7_containers(spark, sf_dir), "packed"), CAPACITY)


def shared_spans(spark: SparkSession, sf_dir: str) -> spans.SharedSpans:
    return spans.SharedSpans(spread(table(spark, sf_dir, "documents", "doc_id", "text")), SHARED_RUN)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a verbatim run of at least 200 characters in common."""
    return shared_spans(spark, sf_dir).pairs()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of every document that stand in another one too."""
    return shared_spans(spark, sf_dir).spans()


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the share of its characters that also stands in another one."""
    return shared_spans(spark, sf_dir).shares()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p3_found, p3_overlaps, p4_found, p4_top, p5_found, p5_words, p6_ids, p6_round_trip, p7_containers, p7_filling, p7_checked, p8_found, p8_spans, p8_share)
    return {f.__name__: f for f in own}


_SETS = """sets AS (SELECT DISTINCT kmer_bits, sample_idx FROM sample_counts
    WHERE cnt >= 1 AND kmer_bits IS NOT NULL AND sample_idx IS NOT NULL),
  sizes AS (SELECT sample_idx, count(*) AS n FROM sets GROUP BY 1),
  pairs AS (SELECT a.sample_idx AS sample_a, b.sample_idx AS sample_b, count(*) AS shared
    FROM sets a JOIN sets b ON a.kmer_bits = b.kmer_bits AND a.sample_idx < b.sample_idx GROUP BY 1, 2),
  sized AS (SELECT sample_a, sample_b, shared, x.n AS size_a, y.n AS size_b
    FROM pairs JOIN sizes x ON x.sample_idx = sample_a JOIN sizes y ON y.sample_idx = sample_b)"""

_COUNTED = """counted AS (SELECT DISTINCT * FROM sample_counts
    WHERE kmer_bits IS NOT NULL AND sample_idx IS NOT NULL AND cnt > 0),
  totals AS (SELECT kmer_bits, CAST(sum(cnt) AS BIGINT) AS total FROM counted GROUP BY 1)"""

_WORDS = """rows_once AS (SELECT DISTINCT * FROM counts_layer),
  numbered AS (SELECT row_number() OVER () AS r, n_cids, counts FROM rows_once),
  tokens AS (SELECT r, unnest(counts[1:n_cids]) AS word FROM numbered WHERE n_cids > 0),
  freq AS (SELECT word, count(*) AS occurrences, count(DISTINCT r) AS records
    FROM tokens WHERE word IS NOT NULL GROUP BY 1),
  marked AS (SELECT word, occurrences, records, CASE WHEN records < 3 THEN 'rare'
    WHEN records >= 0.05 * (SELECT count(*) FROM rows_once) THEN 'common' END AS mark FROM freq)"""

_RUNS = f"""runs AS (SELECT doc_id, i, md5(substr(text, i::INT, {SHARED_RUN})) AS run
    FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SHARED_RUN - 2})) AS i FROM documents WHERE length(text) >= {SHARED_RUN})),
  shared AS (SELECT run FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)),
  held AS (SELECT runs.* FROM runs JOIN shared USING (run)),
  marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {SHARED_RUN} THEN 0 ELSE 1 END AS new FROM held),
  islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
  spans AS (SELECT doc_id, min(i) - 1 AS span_start, max(i) - 1 + {SHARED_RUN} AS span_stop FROM islands GROUP BY doc_id, k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_SETS} SELECT sample_a, sample_b FROM sized WHERE 2 * shared >= least(size_a, size_b)",
        "p3_overlaps": f"WITH {_SETS} SELECT * FROM sized",
        "p4_found": f"WITH {_COUNTED} SELECT kmer_bits FROM totals WHERE total >= (SELECT sum(total) FROM totals) / 500.0",
        "p4_top": f"WITH {_COUNTED} SELECT kmer_bits, total FROM totals ORDER BY total DESC, kmer_bits LIMIT 100",
        "p5_found": f"WITH {_WORDS} SELECT word, mark FROM marked WHERE mark IS NOT NULL",
        "p5_words": f"WITH {_WORDS} SELECT * FROM marked",
        "p6_round_trip": """SELECT doc_id, md5(coalesce(text, '')) AS md5, coalesce(length(text), 0)::INT AS n_chars, coalesce(text, '') <> '' AS any_ids
            FROM (SELECT DISTINCT doc_id, text FROM documents)""",
        "p7_checked": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS homeless, 0::BIGINT AS housed, 0::BIGINT AS split, 0::BIGINT AS torn, true AS close FROM documents",
        "p8_found": f"WITH {_RUNS}, d AS (SELECT DISTINCT doc_id, run FROM held) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.run = b.run AND a.doc_id < b.doc_id",
        "p8_spans": f"WITH {_RUNS} SELECT * FROM spans",
        "p8_share": f"""WITH {_RUNS}, s AS (SELECT doc_id, sum(span_stop - span_start)::BIGINT AS n FROM spans GROUP BY 1)
            SELECT doc_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0::DOUBLE END AS share
            FROM (SELECT DISTINCT doc_id, text FROM documents) LEFT JOIN s USING (doc_id)""",
    }
