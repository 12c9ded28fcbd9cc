"""gff3_attrs takes the attributes of every record."""

from kmerloom.plans import catalog


def test_every_feature_and_entry(spark, tmp_path):
    rows = [
        (1, "gene", {"gene_id": "G", "gene_name": "n=1"}),
        (2, "transcript", {"gene_id": "G", "transcript_id": "T", "transcript_biotype": "lncRNA", "tag": ""}),
        (3, "exon", {"transcript_id": "T", "exon_number": "2", "tag": None}),
        (4, "CDS", None),
    ]
    spark.createDataFrame(rows + rows[:1], "rec_id bigint, feature string, attrs map<string,string>").write.parquet(f"{tmp_path}/gtf_records.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["gff3_attrs"](spark, str(tmp_path)).select("rec_id", "tid", "attrs").collect())
    assert got == [
        (1, None, "Parent=gene=G|gene_id=G|gene_name=n=1|note="),
        (2, "T", "ID=transcript:T|Parent=gene=G|biotype=LNCRNA|gene_id=G|note=|tag=|transcript_biotype=lncRNA|transcript_id=T"),
        (3, None, "exon_number=2|note=|transcript_id=T"),
        (4, None, "note="),
    ]
