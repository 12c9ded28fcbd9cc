"""File readers and streaming ingestion."""

import gzip
import random

import pytest

from kmerloom.sources import files
from kmerloom.streaming import ingest


def write(path, text, zipped=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


FASTQ = "@r1\nACGT\n+\n@III\n@r2\nGGGG\n+x\nIIII\n\n@r3\nTTTT\n+\nIIII\n"


def test_fastq_stops_at_blank_header(spark, tmp_path):
    a, b = write(tmp_path / "a.fastq", FASTQ), write(tmp_path / "b.fq.gz", FASTQ, True)
    rows = files.read_fastq(spark, [a, b]).collect()
    assert sorted((r.path, r.read_idx, r.seq) for r in rows) == [(a, 0, "ACGT"), (a, 1, "GGGG"), (b, 0, "ACGT"), (b, 1, "GGGG")]
    with pytest.raises(Exception, match="blank header"):
        files.read_fastq(spark, a, strict=True).collect()
    with pytest.raises(Exception, match="no '\\+' line"):
        files.read_fastq(spark, write(tmp_path / "c.fq", "@r\nACGT\nIIII\n@")).collect()
    assert files.read_fastq(spark, write(tmp_path / "d.fq", "")).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_fasta(spark, tmp_path, zipped):
    text = "junk before\nmore\n>T1.1 x\nACGT\n\n  ACG \n>empty\n>T2\r\nGG\r\nCC\r\n"
    path = write(tmp_path / ("a.fa.gz" if zipped else "a.fa"), text, zipped)
    rows = files.read_bio(spark, path).collect()
    assert sorted((r.header, r.sequence) for r in rows) == [("T1.1 x", "ACGTACG"), ("T2", "GGCC"), ("empty", "")]


def test_fasta_without_junk(spark, tmp_path):
    rows = files.read_bio(spark, write(tmp_path / "a.fasta", ">T1\nAC\n>T2\nGG")).collect()
    assert sorted((r.header, r.sequence) for r in rows) == [("T1", "AC"), ("T2", "GG")]


GTF = (
    "#comment\n\n1\tsrc\tgene\t1\t9\t.\t+\t.\tgene_id \"G\";\n1\tsrc\ttranscript\t1\t9\t.\t+\t.\n"
    "1\tsrc\ttranscript\t1\t9\t.\t-\t0\ttranscript_id \"T1\"; transcript_biotype \"a\"; tag \"x\"; tag \"y\"; empty \"\"; level 2;\n"
    "1\tsrc\ttranscript\t1\t9\t.\t-\t0\ttranscript_id \"T1\"; transcript_biotype \"b\"\n"
)


def test_gtf(spark, tmp_path):
    path = write(tmp_path / "a.gtf", GTF)
    rows = files.read_bio(spark, path).collect()
    assert [r.feature for r in rows] == ["gene", "transcript", "transcript"]
    assert rows[1].attrs == {"transcript_id": "T1", "transcript_biotype": "a", "tag": "y"} and rows[1].start == 1 and rows[1].strand == "-"
    assert [tuple(r) for r in files.read_transcript_biotypes(spark, write(tmp_path / "b.gtf.gz", GTF, True)).collect()] == [("T1", "b")]


def test_gff3(spark, tmp_path):
    text = "##gff\n1\ts\tmRNA\t1\t9\t.\t+\t.\tID=transcript:T1; biotype=lncRNA;note=;flag;x=a=b\n1\ts\tgene\t1\t9\t.\t+\t.\tID=gene:G;biotype=z\n##FASTA\n>s\nACGT\n"
    path = write(tmp_path / "a.gff3", text)
    rows = files.read_bio(spark, path).collect()
    assert rows[0].attrs == {"ID": "transcript:T1", "biotype": "lncRNA", "note": "", "x": "a=b"} and len(rows) == 2
    assert [tuple(r) for r in files.read_transcript_biotypes(spark, path).collect()] == [("T1", "lncRNA")]


def test_mzid_keeps_the_last(spark, tmp_path):
    text = '<?xml version="1.0"?><M xmlns="http://x/y"><DBSequence id="a"><Seq>MAFW</Seq></DBSequence><DBSequence id="b"><Seq> WPAA </Seq></DBSequence></M>'
    assert sorted(r.seq for r in files.read_bio(spark, write(tmp_path / "a.mzid", text)).collect()) == ["MAFW", "WPAA"]


def test_dispatch():
    assert [files.kind_of(p) for p in ("a.fq", "x/b.fasta.gz", "c.txt.gz", "d.gz", "e.gff")] == ["fastq", "fasta", "fastq", "fastq", "gff3"]
    for p in ("a.txt", "a.FQ", "noext"):
        with pytest.raises(ValueError):
            files.kind_of(p)


def test_annotation_format(spark):
    with pytest.raises(ValueError):
        files.read_transcript_biotypes(spark, "a.txt")
    with pytest.raises(ValueError):
        files.read_transcript_biotypes(spark, "a.fa")


def test_stream_equals_batch_and_replays_are_no_op(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "kmer_bits bigint, sample_idx int, chunk_no int, cnt bigint"
    one = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 1, 3), (2, 1, 0, 1), (None, 1, 0, 1), (3, 1, 0, 0)], schema)
    one.write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.ingest_counts(stream(), out, checkpoint=str(tmp_path / "c"))
    spark.createDataFrame([(1, 2, 0, 7), (1, 1, 0, 2)], schema).write.mode("append").parquet(source)
    for _ in range(2):
        ingest.ingest_counts(stream(), out, checkpoint=str(tmp_path / "c"))
    assert sorted(map(tuple, ingest.ingested(spark, out).collect())) == [(1, 1, 5), (1, 2, 7), (2, 1, 1)]


def test_stream_of_reads(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sample_idx int, seq string"
    spark.createDataFrame([(1, "ATGGCC"), (1, "ATGGCC")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    ingest.ingest_reads(stream, out, 6, checkpoint=str(tmp_path / "c"))
    assert [tuple(r) for r in ingest.ingested_reads(spark, out).collect()] == [(384, 1, 2)]


def fasta_by_hand(text):
    """Records of one file, line by line."""
    records = []
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(">"):
            records.append([line[1:], ""])
        elif line and records:
            records[-1][1] += line
    return sorted(map(tuple, records))


def test_fasta_indented_and_doubled_marks(spark, tmp_path):
    text = "junk\n  >B1\nTT\n  >B2\nCC\n>>C2\nGG\n> D x \n\tAC>\n\n \t>E\r\nA\r\n"
    got = sorted((r.header, r.sequence) for r in files.read_fasta(spark, write(tmp_path / "a.fa", text)).collect())
    assert got == fasta_by_hand(text) and ("B1", "TT") in got and (">C2", "GG") in got and (" D x", "AC>") in got
    assert [tuple(r) for r in files.read_fasta(spark, write(tmp_path / "b.fa", ">>C2\nG")).collect()] == [(">C2", "G")]
    assert files.read_fasta(spark, write(tmp_path / "c.fa", "no record\nat all\n")).count() == 0


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_fasta_of_many_splits_and_files(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    whole = []
    for i in range(3):
        text = "junk\n" * i + "".join(rng.choice([">", " >", ">>", ">"]) + f"T{i}.{j} x\n" + "ACG\n" * rng.randrange(40) for j in range(30))
        write(tmp_path / f"{i}.fa", text)
        whole += fasta_by_hand(text)
    df = files.read_fasta(spark, f"file://{tmp_path}/*.fa")
    assert df.rdd.getNumPartitions() > 10
    assert sorted((r.header, r.sequence) for r in df.collect()) == sorted(whole)


def fastq_by_hand(text):
    lines, reads = text.split("\n"), []
    if lines[-1] == "":
        lines.pop()
    for i in range(0, len(lines), 4):
        if not lines[i].strip():
            break
        reads.append(lines[i + 1].strip())
    return reads


@pytest.mark.parametrize("stop", [None, 0, 37])
def test_fastq_of_many_splits(spark, tmp_path, tiny_splits, stop):
    """Quality lines like headers, lines longer than a split, a blank header in the middle; one file by name, all by pattern, folder and URI."""
    rng = random.Random(3)
    want = {}
    for name in ("a.fq", "b.fastq"):
        reads = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 30, 400]))) for _ in range(60)]
        text = "".join(("\n" if i == stop else f"@r{i}\n") + f"{r}\n+\n{'@' * len(r)}\n" for i, r in enumerate(reads))
        write(tmp_path / name, text[:-1] if name == "a.fq" else text)
        want[name] = fastq_by_hand(text)
    single = str(tmp_path / "a.fq")
    df = files.read_fastq(spark, single)
    assert df.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, df.collect())) == [(single, i, r) for i, r in enumerate(want["a.fq"])]
    for path in (str(tmp_path), f"file://{tmp_path}/*", [f"file://{tmp_path}/a.fq", str(tmp_path / "b.fastq")]):
        got = files.read_fastq(spark, path).collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.read_idx, r.seq) for r in got) == sorted((n, i, r) for n, x in want.items() for i, r in enumerate(x))
    if stop is not None:
        with pytest.raises(Exception, match=f"blank header after read {stop}"):
            files.read_fastq(spark, single, strict=True).collect()


def test_fastq_errors_across_splits(spark, tmp_path, tiny_splits):
    text = "".join(f"@r{i}\n{'ACGT' * 30}\n{'-' if i == 11 else '+'}\n{'I' * 120}\n" for i in range(20))
    with pytest.raises(Exception, match="no '\\+' line in read 11"):
        files.read_fastq(spark, write(tmp_path / "a.fq", text)).collect()


def test_fastq_last_record_without_quality(spark, tmp_path):
    assert [r.seq for r in files.read_fastq(spark, write(tmp_path / "a.fq", "@r\nAC\n+\nII\n@s\nGG\n+")).collect()] == ["AC", "GG"]
    with pytest.raises(Exception, match="no '\\+' line in read 1"):
        files.read_fastq(spark, write(tmp_path / "b.fq.gz", "@r\nAC\n+\nII\n@s\nGG\n", True)).collect()


def test_bad_numbers_of_an_annotation(spark, tmp_path):
    path = write(tmp_path / "a.gtf", '1\ts\tgene\tx1\t9\t.\t+\t.\tgene_id "G";\n')
    with pytest.raises(Exception, match="field 4 is no number"):
        files.read_gtf(spark, path).collect()
    assert files.read_gtf(spark, path, strict=False).first().start is None


def test_last_line_wins_over_files_by_name(spark, tmp_path):
    line = '1\ts\ttranscript\t1\t9\t.\t+\t.\ttranscript_id "T"; transcript_biotype "{}"\n'
    (tmp_path / "x.gtf").mkdir()
    write(tmp_path / "x.gtf" / "part-0", line.format("a") + line.format("b") + line.format("c") * 50)
    write(tmp_path / "x.gtf" / "part-1", line.format("d"))
    assert files.read_transcript_biotypes(spark, str(tmp_path / "x.gtf")).first().biotype == "d"


def test_reads_that_arrive_again_count_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sample_idx int, id string, seq string"
    spark.createDataFrame([(1, "a", "ATGGCC"), (1, "a", "ATGGCC"), (1, "b", "ATGGCC"), (1, None, "ATGGCC")], schema).write.parquet(source)
    take = lambda: ingest.ingest_reads(spark.readStream.schema(schema).parquet(source), out, 6, checkpoint=str(tmp_path / "c"), read_id="id")
    take()
    spark.createDataFrame([(1, "b", "ATGGCC"), (2, "b", "ATGGCC"), (1, "c", "ATGGCC")], schema).write.mode("append").parquet(source)
    take()
    take()
    assert sorted(map(tuple, ingest.ingested_reads(spark, out).collect())) == [(384, 1, 4), (384, 2, 1)]
