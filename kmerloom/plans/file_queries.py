"""Queries that write tables as files into the shared folder and read them back, and tables built from such files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import AA28, FORMAT_VERSION
from ..durable import fresh_path, materialise, remove_at_exit, spread, table, unique_rows
from ..functions import attributes
from ..functions.kmers import geometry
from ..operators import metrics
from ..operators.table import KmerTable
from ..sources import files, store
from . import pipelines
from .kmer_queries import _ANNOTATED, _ANNOTATION, _COUNTS, _UNPACK, _WIDE, _WINDOWS, K, RESIDUES, annotated_reads, cohort, reads, text, transcripts

#: Letters of a sequence line.
LINE = 60


# writers


def _write(lines: DataFrame, extension: str, **options) -> str:
    """The lines as a folder of text files whose name has the extension."""
    spark = lines.sparkSession
    path = fresh_path(spark, "file", f".{extension}")
    lines.write.text(path, **options)
    remove_at_exit(spark, path)
    return path


def _some(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def fastq_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """FASTQ records of ``(rec_id, seq)``; the quality lines start with ``@``."""
    seq = _some("seq")
    return rows.select(F.concat(F.lit("@"), _some("rec_id"), F.lit("\n"), seq, F.lit("\n+\n@"), F.repeat(F.lit("I"), F.length(seq))).alias("value"), *keep)


def fasta_lines(rows: DataFrame, marks: bool) -> DataFrame:
    """FASTA records of ``(rec_id, header, sequence)``; with ``marks`` every third is indented and every seventh has a second ``>``."""
    indent = F.when((F.col("rec_id") % 3 == 0) & F.lit(marks), "  ").otherwise("")
    second = F.when((F.col("rec_id") % 7 == 0) & F.lit(marks), ">").otherwise("")
    lines = F.regexp_replace(_some("sequence"), f"(.{{{LINE}}})", "$1\n")
    return rows.select(F.concat(indent, F.lit(">"), second, _some("header"), F.lit("\n"), lines).alias("value"))


def _annotation_lines(rows: DataFrame, attrs: Column) -> DataFrame:
    """Annotation lines in the order of ``rec_id``, over the files by their names too."""
    ordered = rows.repartitionByRange("rec_id").sortWithinPartitions("rec_id")
    fields = [_some("seqname"), F.lit("src"), _some("feature"), _some("start_pos"), _some("stop_pos"), F.lit("."), _some("strand"), F.lit("."), F.coalesce(attrs, F.lit(""))]
    return ordered.select(F.concat_ws("\t", *fields).alias("value"))


def _items(item, mark: str) -> Column:
    held = F.filter(F.map_entries("attrs"), lambda e: e["value"].isNotNull())
    return F.array_join(F.transform(held, item), mark)


def gtf_lines(rows: DataFrame) -> DataFrame:
    return _annotation_lines(rows, _items(lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('"')), "; "))


def gff3_lines(rows: DataFrame) -> DataFrame:
    """GFF3 lines; a transcript also has the ``ID`` and the ``biotype`` by which it is known."""
    own = F.when(F.col("feature") == "transcript", F.concat_ws(
        ";", F.concat(F.lit("ID=transcript:"), F.col("attrs")["transcript_id"]), F.concat(F.lit("biotype="), F.col("attrs")["transcript_biotype"])
    ))
    return _annotation_lines(rows, F.concat_ws(";", own, _items(lambda e: F.concat(e["key"], F.lit("="), e["value"]), ";")))


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_rows(table(spark, sf_dir, "gtf_records", "rec_id", "seqname", "feature", "start_pos", "stop_pos", "strand", "attrs", "deleted_at"), "rec_id", "rec_id")


# files


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _fastq(spark: SparkSession, sf_dir: str, extension: str, **options) -> DataFrame:
    return files.read_bio(spark, _write(fastq_lines(reads(spark, sf_dir)), extension, **options)).select("seq")


def _fasta(spark: SparkSession, sf_dir: str, extension: str, **options) -> DataFrame:
    return files.read_bio(spark, _write(fasta_lines(transcripts(spark, sf_dir), True), extension, **options))


def _annotated(rows: DataFrame) -> DataFrame:
    return rows.select("seqname", "feature", F.col("start").alias("start_pos"), F.col("stop").alias("stop_pos"), "strand", attributes.map_text("attrs").alias("attrs"))


def _gtf(spark: SparkSession, sf_dir: str, extension: str, **options) -> DataFrame:
    return _annotated(files.read_bio(spark, _write(gtf_lines(annotation_rows(spark, sf_dir)), extension, **options)))


def _gff3(spark: SparkSession, sf_dir: str, extension: str, **options) -> DataFrame:
    return _annotated(files.read_bio(spark, _write(gff3_lines(annotation_rows(spark, sf_dir)), extension, **options)))


def file_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and read again."""
    return _counted(_fastq(spark, sf_dir, "fastq"))


def file_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as FASTA, some indented or with a second ``>``, and read again."""
    return _counted(_fasta(spark, sf_dir, "fa"))


def file_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation written as GTF and read again."""
    return _counted(_gtf(spark, sf_dir, "gtf"))


def file_gff3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation written as GFF3 and read again."""
    return _counted(_gff3(spark, sf_dir, "gff3"))


def _documents(lines: DataFrame) -> DataFrame:
    """The lines of every partition, and so of every file, as one XML document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield line('<?xml version="1.0" encoding="UTF-8"?><MzIdentML xmlns="http://psidev.info/psi/pi/mzIdentML/1.1"><SequenceCollection>')
        yield from batches
        yield line("</SequenceCollection></MzIdentML>")

    return lines.mapInArrow(run, "value string")


def file_mzid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as elements of identification files and read again."""
    rows = reads(spark, sf_dir).where("seq <> ''")
    lines = rows.select(F.concat(F.lit('<DBSequence id="'), _some("rec_id"), F.lit('"><Seq>'), F.col("seq"), F.lit("</Seq></DBSequence>")).alias("value"))
    return _counted(files.read_bio(spark, _write(_documents(lines), "mzid")))


def file_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four text formats written with gzip, chosen by the extension before ``.gz``."""
    out = None
    for extension, rows in (("fq", _fastq), ("fasta", _fasta), ("gtf", _gtf), ("gff", _gff3)):
        read = rows(spark, sf_dir, f"{extension}.gz", compression="gzip")
        line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in read.columns])
        part = _counted(read.select(F.lit(extension).alias("kind"), line.alias("record")))
        out = part if out is None else out.unionByName(part)
    return out


def gff3_biotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biotypes of the transcripts of a GFF3 file, the last line of each counting."""
    live = annotation_rows(spark, sf_dir).where("deleted_at is null")
    return files.read_transcript_biotypes(spark, _write(gff3_lines(live), "gff3"))


def stripped_biotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biotypes of the transcripts of a GTF file, ids without their versions."""
    live = annotation_rows(spark, sf_dir).where("deleted_at is null")
    return files.read_transcript_biotypes(spark, _write(gtf_lines(live), "gtf"), strip_version=True)


# tables


def _stored(spark: SparkSession, t: KmerTable) -> str:
    path = fresh_path(spark, "table")
    store.write_table(t, path)
    remove_at_exit(spark, path)
    return path


def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotated table written and loaded: keys, counts and masks."""
    back = store.load_table(spark, _stored(spark, annotated_reads(spark, sf_dir)))
    return back.wide().select("kmer_bits", text("counts").alias("counts"), "biotype_mask")


def table_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written table says of itself."""
    meta = store.read_meta(spark, _stored(spark, cohort(spark, sf_dir)))
    row = (meta["format_version"], meta["residues"], meta["alphabet"], meta["layers_mask"], meta["n_kmers"], meta["samples"])
    return spark.createDataFrame([row], "format_version double, residues int, alphabet string, layers_mask int, n_kmers bigint, samples int")


def table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the written positions, and how many stand behind a greater key of their file or have not the next position."""
    path = _stored(spark, cohort(spark, sf_dir))
    rows = spark.read.parquet(f"{path}/positions").select("kmer_bits", "pos", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    before = Window.partitionBy("file").orderBy("id")
    wrong = (F.lag("kmer_bits").over(before) >= F.col("kmer_bits")) | (F.lag("pos").over(before) + 1 != F.col("pos"))
    return rows.withColumn("wrong", wrong).agg(F.count(F.lit(1)).alias("n_kmers"), F.count_if("wrong").alias("out_of_order"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the table with their positions, keys as text."""
    return cohort(spark, sf_dir).rows().select("pos", "kmer_bits", "kmer", text("counts").alias("counts"))


def layer_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers that written tables say they have: none, counts, biotypes, both."""
    both = annotated_reads(spark, sf_dir)
    tables = {"none": KmerTable(RESIDUES, bare=both.keys), "counts": KmerTable(RESIDUES, both.counts, samples=12), "biotypes": KmerTable(RESIDUES, masks=both.masks, names=both.names), "both": both}
    rows = []
    for name, t in tables.items():
        path = _stored(spark, t)
        rows.append((name, store.read_meta(spark, path)["layers_mask"], store.load_table(spark, path).length()))
    return spark.createDataFrame(rows, "layers string, layers_mask int, n_kmers bigint")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys after every sample, recorded run by run and read back."""
    path = fresh_path(spark, "history", ".json")
    runs = metrics.cardinality_growth(cohort(spark, sf_dir).counts).orderBy("sample_idx").collect()  # one row per sample
    for r in runs:
        metrics.append_history(path, {"samples": r.sample_idx, "n_kmers": r.unique_kmers}, spark)
    remove_at_exit(spark, path)
    back = metrics.load_history(path, spark)
    return spark.createDataFrame([(i, r["samples"], r["n_kmers"]) for i, r in enumerate(back, 1)], "run int, samples int, n_kmers bigint")


def key_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the residues of keys of up to forty residues lie in words of 64 bits."""
    rows = [(n, i, *(geometry(n, i)[c] for c in ("words", "offset", "word", "shift", "straddles"))) for n in range(1, 41) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "residues int, i int, words int, offset int, word int, shift int, straddles int")


def sampled_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys drawn with replacement and looked up: whether any was drawn, and how many were not found."""
    t = cohort(spark, sf_dir)
    drawn = materialise(t.positions.select("kmer_bits").sample(withReplacement=True, fraction=1.0, seed=1), "probes")
    return t.lookup(drawn).agg((F.count(F.lit(1)) > 0).alias("any_drawn"), F.count_if(F.col("pos") == 0).alias("missed"))


def _sample_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A folder of FASTQ files per month of loading, an empty one for a month without reads."""
    rows = reads(spark, sf_dir).where("sample_idx is not null")
    folder = fresh_path(spark, "samples")
    fastq_lines(spread(rows), "sample_idx").write.partitionBy("sample_idx").text(folder)
    remove_at_exit(spark, folder)
    there = {r[0] for r in rows.select("sample_idx").distinct().collect()}  # at most twelve
    for i in range(1, 13):
        if i not in there:
            spark.createDataFrame([], "value string").write.text(f"{folder}/sample_idx={i}")
    return [f"{folder}/sample_idx={i}" for i in range(1, 13)]


def saved_in_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the first six samples as it was saved while the table of all was built."""
    out = fresh_path(spark, "saved")
    pipelines.build_kmer_table(spark, _sample_files(spark, sf_dir), K, save_at=[6], save_path=out)
    remove_at_exit(spark, out)
    path = next(str(s.getPath().toString()) for s in spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(out)))
    return store.load_table(spark, path).wide().select("kmer_bits", text("counts").alias("counts"))


def build_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, transcripts and annotation written as files, and the annotated table built from these."""
    t = pipelines.build_kmer_table(spark, _sample_files(spark, sf_dir), K)
    fasta = _write(fasta_lines(transcripts(spark, sf_dir), False), "fa")
    gtf = _write(gtf_lines(annotation_rows(spark, sf_dir).where("deleted_at is null")), "gtf")
    index = pipelines.build_genomic_index(spark, fasta, gtf, K)
    return t.add_biotypes(index).wide().select("kmer_bits", text("counts").alias("counts"), "biotype_mask")


# figures


def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the parts of the table in its packed form."""
    return metrics.packed_sizes(cohort(spark, sf_dir))


def plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the plots over the samples, from the figures of every prefix of them."""
    t = cohort(spark, sf_dir)
    grown = metrics.cardinality_growth(t.counts).select(F.col("sample_idx").alias("samples"), F.col("unique_kmers").alias("n_kmers"))
    times = table(spark, sf_dir, "kct_samples", "sample_idx", "added_at")
    return metrics.plot_rows(grown.join(times, F.col("samples") == F.col("sample_idx")).select("samples", F.col("added_at").alias("timestamp"), "n_kmers"))


_OWN = (
    file_fastq, file_fasta, file_gtf, file_gff3, file_mzid, file_gz, gff3_biotypes, stripped_biotypes, table_round_trip, table_meta, table_order,
    table_rows, layer_masks, run_history, key_geometry, sampled_lookups, saved_in_build, build_from_files, packed_sizes, plot_rows,
)
QUERIES = {f.__name__: f for f in _OWN}

# The same rows in SQL.

_FQ = "fq AS (SELECT trim(coalesce(sequence, ''), ' ' || chr(9) || chr(13)) AS seq FROM (SELECT DISTINCT rec_id, sequence, loaded_at FROM fasta_records))"
_FA = """fa AS (SELECT rtrim(CASE WHEN rec_id % 7 = 0 THEN '>' ELSE '' END || coalesce(header, ''), ' ' || chr(9) || chr(13)) AS header, coalesce(sequence, '') AS sequence
    FROM (SELECT DISTINCT rec_id, header, sequence FROM fasta_records))"""
_ROWS = "ann AS (SELECT DISTINCT ON (rec_id) rec_id, coalesce(seqname, '') AS seqname, coalesce(feature, '') AS feature, start_pos, stop_pos, coalesce(strand, '') AS strand, attrs, deleted_at FROM gtf_records)"
_ENTRIES = "list_transform(list_filter(map_entries(attrs), lambda e: {keep}), lambda e: concat(e.key, '=', {value}))"
_GTF = f"""gtf AS (SELECT seqname, feature, start_pos, stop_pos, strand,
    array_to_string(list_sort(coalesce({_ENTRIES.format(keep="e.value <> ''", value="e.value")}, [])), '|') AS attrs FROM ann)"""
_GFF = f"""gff AS (SELECT seqname, feature, start_pos, stop_pos, strand, array_to_string(list_sort(coalesce({_ENTRIES.format(keep="e.value IS NOT NULL", value="rtrim(e.value, ' ')")}, [])
    || list_filter([CASE WHEN feature = 'transcript' THEN 'ID=transcript:' || rtrim(attrs['transcript_id'], ' ') END, CASE WHEN feature = 'transcript' THEN 'biotype=' || rtrim(attrs['transcript_biotype'], ' ') END],
      lambda x: x IS NOT NULL)), '|') AS attrs FROM ann)"""
_RECORD = "concat_ws(chr(9), seqname, feature, start_pos, stop_pos, strand, attrs)"
_QUOTED = lambda sql: sql.replace("attrs['transcript_id']", "nullif(attrs['transcript_id'], '')").replace("attrs['transcript_biotype']", "nullif(attrs['transcript_biotype'], '')")

ORACLE = {
    "file_fastq": f"WITH {_FQ} SELECT seq, count(*) AS n FROM fq GROUP BY 1",
    "file_fasta": f"WITH {_FA} SELECT header, sequence, count(*) AS n FROM fa GROUP BY 1, 2",
    "file_gtf": f"WITH {_ROWS}, {_GTF} SELECT *, count(*) AS n FROM gtf GROUP BY ALL",
    "file_gff3": f"WITH {_ROWS}, {_GFF} SELECT *, count(*) AS n FROM gff GROUP BY ALL",
    "file_mzid": f"WITH {_FQ} SELECT seq, count(*) AS n FROM fq WHERE seq <> '' GROUP BY 1",
    "file_gz": f"""WITH {_FQ}, {_FA}, {_ROWS}, {_GTF}, {_GFF}, r AS (SELECT 'fq' AS kind, seq AS record FROM fq UNION ALL SELECT 'fasta', header || chr(9) || sequence FROM fa
        UNION ALL SELECT 'gtf', {_RECORD} FROM gtf UNION ALL SELECT 'gff', {_RECORD} FROM gff) SELECT kind, record, count(*) AS n FROM r GROUP BY 1, 2""",
    "gff3_biotypes": f"WITH {_ANNOTATION} SELECT rtrim(tid, ' ') AS tid, arg_max(rtrim(biotype, ' '), tid) AS biotype FROM anno GROUP BY 1",
    "stripped_biotypes": _QUOTED("""SELECT split_part(attrs['transcript_id'], '.', 1) AS tid, arg_max(attrs['transcript_biotype'], rec_id) AS biotype FROM gtf_records
        WHERE deleted_at IS NULL AND feature = 'transcript' AND attrs['transcript_id'] IS NOT NULL AND attrs['transcript_biotype'] IS NOT NULL GROUP BY 1"""),
    "table_round_trip": f"""WITH {_ANNOTATED}, h AS (SELECT kmer_bits, map_from_entries(list({{'k': sample_idx, 'v': cnt}})) AS m FROM keyed GROUP BY 1)
        SELECT kmer_bits, array_to_string(list_transform(range(1, 13), lambda i: coalesce(m[i::INT], 0)), ',') AS counts, biotype_mask FROM h JOIN annotated USING (kmer_bits)""",
    "table_meta": f"WITH {_COUNTS} SELECT {FORMAT_VERSION}::DOUBLE AS format_version, {RESIDUES}::INT AS residues, '{AA28}' AS alphabet, 1::INT AS layers_mask, count(*) AS n_kmers, max(n)::INT AS samples FROM keys, n",
    "table_order": f"WITH {_COUNTS} SELECT count(*) AS n_kmers, 0::BIGINT AS out_of_order FROM keys",
    "table_rows": f"WITH {_COUNTS}, {_WIDE} SELECT pos, kmer_bits, {_UNPACK('kmer_bits')} AS kmer, array_to_string(counts, ',') AS counts FROM placed JOIN vectors USING (kmer_bits)",
    "layer_masks": f"WITH {_ANNOTATED} SELECT layers, layers_mask::INT AS layers_mask, (SELECT count(*) FROM annotated) AS n_kmers FROM (VALUES ('none', 0), ('counts', 1), ('biotypes', 2), ('both', 3)) t(layers, layers_mask)",
    "run_history": f"""WITH {_COUNTS}, f AS (SELECT kmer_bits, min(sample_idx) AS sample_idx FROM counts GROUP BY 1), g AS (SELECT sample_idx, count(*) AS n FROM f GROUP BY 1)
        SELECT (row_number() OVER (ORDER BY sample_idx))::INT AS run, sample_idx AS samples, (sum(coalesce(n, 0)) OVER (ORDER BY sample_idx))::BIGINT AS n_kmers
        FROM (SELECT DISTINCT sample_idx FROM counts) LEFT JOIN g USING (sample_idx)""",
    "key_geometry": """WITH r AS (SELECT unnest(range(1, 41)) AS n), x AS (SELECT n, unnest(range(1, n + 1)) AS i, (5 * n + 63) // 64 AS w FROM r)
        SELECT n::INT AS residues, i::INT AS i, w::INT AS words, (64 * w - 5 * n)::INT AS offset, (w - 1 - 5 * (n - i) // 64)::INT AS word, (5 * (n - i) % 64)::INT AS shift,
          (5 * (n - i) % 64 > 59)::INT AS straddles FROM x""",
    "saved_in_build": f"""WITH {_WINDOWS}, h AS (SELECT kmer_bits, map_from_entries(list({{'k': sample_idx, 'v': cnt}})) AS m FROM keyed WHERE sample_idx <= 6 GROUP BY 1)
        SELECT kmer_bits, array_to_string(list_transform(range(1, 7), lambda i: coalesce(m[i::INT], 0)), ',') AS counts FROM h""",
    "sampled_lookups": f"WITH {_COUNTS} SELECT count(*) > 0 AS any_drawn, 0::BIGINT AS missed FROM keys",
    "build_from_files": f"""WITH {_QUOTED(_ANNOTATED)}, h AS (SELECT kmer_bits, map_from_entries(list({{'k': sample_idx, 'v': cnt}})) AS m FROM keyed WHERE sample_idx IS NOT NULL GROUP BY 1)
        SELECT kmer_bits, array_to_string(list_transform(range(1, 13), lambda i: coalesce(m[i::INT], 0)), ',') AS counts, biotype_mask FROM h JOIN annotated USING (kmer_bits)""",
    "packed_sizes": f"""WITH {_COUNTS}, w AS (SELECT kmer_bits, (sample_idx - 1) // 4 AS g, sum(least(cnt, 65535)::HUGEINT << (16 * ((sample_idx - 1) % 4))::INT) AS word FROM counts GROUP BY 1, 2),
        k AS (SELECT kmer_bits, max(g) + 1 AS words, count(*) AS held FROM w GROUP BY 1), s AS (SELECT count(*) AS n, sum(words)::BIGINT AS words, sum(held)::BIGINT AS held FROM k),
        d AS (SELECT count(DISTINCT word) AS d FROM w), p AS (SELECT kmer_bits - lag(kmer_bits) OVER (ORDER BY kmer_bits) AS delta, row_number() OVER (ORDER BY kmer_bits) AS pos FROM keys),
        o AS (SELECT count_if(delta >= 4294967296 AND (pos - 1) % 256 <> 0)::BIGINT AS o FROM p), c AS (SELECT n, words, d + (words > held)::INT AS d, o, (n + 255) // 256 AS r FROM s, d, o)
        SELECT n AS n_kmers, 8 * (2 * r + o) + 4 * n AS kmer_seq_bytes, 8 * (r + o) AS checkpoints_bytes, 4 * n AS deltas_bytes, 8 * r AS regular_cp_idx_bytes, 4 * words AS chunk_ids_bytes,
          2 * n AS n_cids_bytes, 8 * d AS count_words_bytes, 8 * ((4 * d + 63) // 64) AS bitmap_bytes FROM c""",
    "plot_rows": f"""WITH {_COUNTS}, f AS (SELECT kmer_bits, min(sample_idx) AS sample_idx FROM counts GROUP BY 1), g AS (SELECT sample_idx, count(*) AS n FROM f GROUP BY 1),
        u AS (SELECT sample_idx AS samples, sum(coalesce(n, 0)) OVER (ORDER BY sample_idx) AS n_kmers FROM (SELECT DISTINCT sample_idx FROM counts) LEFT JOIN g USING (sample_idx)),
        t AS (SELECT samples, n_kmers, epoch(added_at) AS s FROM u JOIN kct_samples ON samples = sample_idx)
        SELECT 'kmer_cardinality' AS plot, 'n_kmers' AS series, samples::DOUBLE AS x, n_kmers::DOUBLE AS y FROM t
        UNION ALL SELECT 'elapsed_time', 'hours_since_last', samples, (s - lag(s) OVER (ORDER BY samples)) / 3600 FROM t QUALIFY lag(s) OVER (ORDER BY samples) IS NOT NULL
        UNION ALL SELECT 'elapsed_time', 'hours_since_first', samples, (s - first_value(s) OVER (ORDER BY samples)) / 3600 FROM t""",
}
