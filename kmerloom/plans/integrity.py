"""Queries on rows that fail to parse and on references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import table
from ..operators import error_parse, references


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows that fail to parse, with the reason."""
    gtf = error_parse.load_gtf(table(spark, sf_dir, "gtf_raw"))[1]
    fasta = error_parse.load_fasta(table(spark, sf_dir, "fasta_raw"))[1]
    return gtf.select(F.lit("gtf_raw").alias("src_table"), "raw_id", "reason").unionByName(
        fasta.select(F.lit("fasta_raw").alias("src_table"), "raw_id", "reason")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows that fail to parse."""
    return p1_reasons(spark, sf_dir).select("src_table", "raw_id").distinct()


def p1_gtf_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid annotation lines as records, attributes as sorted text."""
    records = error_parse.load_gtf(table(spark, sf_dir, "gtf_raw"))[0]
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return records.withColumn("attrs", text).drop("deleted_at").distinct()


def p1_fasta_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid transcripts as records."""
    return error_parse.load_fasta(table(spark, sf_dir, "fasta_raw"))[0].distinct()


def p1_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table the rows that are raw, skipped, loaded and failed, repeated ones counted as often: nothing is lost between them."""
    out = None
    for name, load, text in (("gtf_raw", error_parse.load_gtf, "line"), ("fasta_raw", error_parse.load_fasta, "record")):
        raw = table(spark, sf_dir, name, "raw_id", text, "loaded_at").distinct()
        records, failures = load(raw)
        kinds = [
            raw.select(F.lit("raw").alias("kind")), records.select(F.lit("loaded").alias("kind")), failures.select(F.lit("failed").alias("kind")),
        ]
        if name == "gtf_raw":
            kinds.append(raw.where(error_parse.skipped(F.col(text))).select(F.lit("skipped").alias("kind")))
        for kind in kinds:
            counted = kind.groupBy(F.lit(name).alias("src_table"), "kind").agg(F.count(F.lit(1)).alias("n"))
            out = counted if out is None else out.unionByName(counted)
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    sums = out.groupBy("src_table").agg(*[count(k).alias(k) for k in ("raw", "skipped", "loaded", "failed")])
    return sums.withColumn("lost", F.expr("raw - skipped - loaded - failed"))


def p2_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, with key and reason."""
    gtf = table(spark, sf_dir, "gtf_records", "rec_id", "feature", "attrs", "loaded_at", "deleted_at")
    fasta = table(spark, sf_dir, "fasta_records", "rec_id", "header", "loaded_at")
    named = references.annotation_references(gtf).unionByName(references.header_references(fasta))
    return references.dangling(references.annotation_parents(gtf), named)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target."""
    return p2_dangling(spark, sf_dir).select("ref_table", "ref_field", "rec_id").distinct()


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of dangling references per table and month of loading."""
    rows = p2_dangling(spark, sf_dir).select("ref_table", "ref_field", "rec_id", F.date_format("loaded_at", "yyyy-MM").alias("month"))
    return rows.distinct().groupBy("ref_table", "month").agg(F.count(F.lit(1)).alias("dangling"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_conserved, p1_gtf_loaded, p1_fasta_loaded, p2_found, p2_dangling, p2_by_month)}

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_ITEM = f' *{_NAME} +(?:"[^"]*"|[0-9]+) *'
_LINES = rf"""gtf AS (SELECT *, string_split(line, chr(9)) AS f FROM gtf_raw
    WHERE line IS NULL OR NOT (starts_with(line, '#') OR regexp_full_match(line, '[ \t]*'))),
  gtf_ok AS (SELECT *, coalesce(len(f) = 9 AND regexp_full_match(f[4], '[0-9]{{1,18}}') AND regexp_full_match(f[5], '[0-9]{{1,18}}')
    AND f[7] IN ('+', '-', '.') AND try_cast(f[4] AS BIGINT) >= 1 AND try_cast(f[4] AS BIGINT) <= try_cast(f[5] AS BIGINT)
    AND regexp_full_match(f[9], '{_ITEM}(?:;{_ITEM})*;? *', 's'), false) AS ok FROM gtf)"""
_RECORDS = r"""fa AS (SELECT *, list_filter(list_transform(string_split(record, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM fasta_raw),
  fa_ok AS (SELECT *, coalesce(regexp_matches(l[1], '^>[^ \t]') AND regexp_full_match(array_to_string(l[2:], ''), '[ACGTURYSWKMBDHVNacgturyswkmbdhvn]+'), false) AS ok FROM fa)"""
_DANGLING = """parent AS (
    SELECT 'gene_id' AS field, attrs['gene_id'] AS key, min(loaded_at) AS since FROM gtf_records WHERE feature = 'gene' AND deleted_at IS NULL GROUP BY 1, 2
    UNION ALL SELECT 'transcript_id', attrs['transcript_id'], min(loaded_at) FROM gtf_records WHERE feature = 'transcript' AND deleted_at IS NULL GROUP BY 1, 2),
  refs AS (
    SELECT 'gtf_records' AS ref_table, 'gene_id' AS ref_field, attrs['gene_id'] AS key, rec_id, loaded_at FROM gtf_records WHERE feature = 'transcript' AND deleted_at IS NULL
    UNION SELECT 'gtf_records', 'transcript_id', attrs['transcript_id'], rec_id, loaded_at FROM gtf_records WHERE feature NOT IN ('gene', 'transcript') AND deleted_at IS NULL
    UNION SELECT 'fasta_records', 'transcript_id', split_part(split_part(header, ' ', 1), '.', 1), rec_id, loaded_at FROM fasta_records
    UNION SELECT 'fasta_records', 'gene_id', split_part(substring(list_filter(string_split(header, ' ')[2:], lambda t: starts_with(t, 'gene:'))[1], 6), '.', 1), rec_id, loaded_at FROM fasta_records),
  dangling AS (SELECT r.*, CASE WHEN p.since IS NULL THEN 'missing' ELSE 'late' END AS reason
    FROM refs r LEFT JOIN parent p ON p.field = r.ref_field AND p.key = r.key
    WHERE r.key <> '' AND (p.since IS NULL OR r.loaded_at IS NULL OR p.since > r.loaded_at))"""

_PAIR = f'({_NAME}) +(?:"([^"]*)"|([0-9]+))'
_ATTRIBUTES = f"""pairs AS (SELECT *, regexp_extract_all(f[9], '{_PAIR}', 1) AS k, regexp_extract_all(f[9], '{_PAIR}', 2) AS a,
    regexp_extract_all(f[9], '{_PAIR}', 3) AS b FROM gtf_ok WHERE ok)"""

ORACLE = {
    "p1_found": f"WITH {_LINES}, {_RECORDS} SELECT DISTINCT 'gtf_raw' AS src_table, raw_id FROM gtf_ok WHERE NOT ok UNION ALL SELECT DISTINCT 'fasta_raw', raw_id FROM fa_ok WHERE NOT ok",
    "p1_conserved": f"""WITH {_LINES.replace("FROM gtf_raw", "FROM (SELECT DISTINCT raw_id, line, loaded_at FROM gtf_raw)")}, {_RECORDS.replace("FROM fasta_raw", "FROM (SELECT DISTINCT raw_id, record, loaded_at FROM fasta_raw)")},
    n AS (SELECT 'gtf_raw' AS src_table, (SELECT count(*) FROM (SELECT DISTINCT raw_id, line, loaded_at FROM gtf_raw)) AS raw, count(*) AS held, count_if(ok)::BIGINT AS loaded FROM gtf_ok
      UNION ALL SELECT 'fasta_raw', (SELECT count(*) FROM (SELECT DISTINCT raw_id, record, loaded_at FROM fasta_raw)), count(*), count_if(ok)::BIGINT FROM fa_ok)
    SELECT src_table, raw, raw - held AS skipped, loaded, held - loaded AS failed, 0::BIGINT AS lost FROM n""",
    "p1_gtf_loaded": f"""WITH {_LINES}, {_ATTRIBUTES} SELECT DISTINCT raw_id AS rec_id, f[1] AS seqname, f[3] AS feature, CAST(f[4] AS BIGINT) AS start_pos,
    CAST(f[5] AS BIGINT) AS stop_pos, f[7] AS strand, array_to_string(list_sort(list_transform(list_filter(range(1, len(k) + 1),
      lambda i: NOT list_contains(k[i + 1:], k[i])), lambda i: concat(k[i], '=', a[i], b[i]))), '|') AS attrs, loaded_at FROM pairs""",
    "p1_fasta_loaded": f"WITH {_RECORDS} SELECT DISTINCT raw_id AS rec_id, substring(l[1], 2) AS header, array_to_string(l[2:], '') AS sequence, loaded_at FROM fa_ok WHERE ok",
    "p2_found": f"WITH {_DANGLING} SELECT DISTINCT ref_table, ref_field, rec_id FROM dangling",
    "p2_dangling": f"WITH {_DANGLING} SELECT ref_table, ref_field, rec_id, key, loaded_at, reason FROM dangling",
    "p2_by_month": f"WITH {_DANGLING}, d AS (SELECT DISTINCT ref_table, ref_field, rec_id, strftime(loaded_at, '%Y-%m') AS month FROM dangling) SELECT ref_table, month, count(*) AS dangling FROM d GROUP BY 1, 2",
}
