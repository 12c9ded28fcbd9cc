"""The pushes take in every sample."""

import os

import pytest

from kmerloom.plans import catalog

DATA = "/root/testdata/sf0.001"
PUSHES = ["push_full_outer", "push_samples"]


@pytest.mark.parametrize("name", PUSHES)
def test_every_sample_is_pushed(spark, tmp_path, name):
    """Keys held only by late samples, an empty sample, a replayed row, two chunks and rows that do not count."""
    counts = [(10, 1, 0, 4), (10, 5, 0, 2), (10, 5, 1, 3), (20, 4, 0, 7), (20, 4, 0, 7), (30, 5, 0, 1), (None, 4, 0, 9), (40, None, 0, 9), (50, 2, 0, 0), (60, 2, 0, 8)]
    spark.createDataFrame(counts, "kmer_bits bigint, sample_idx int, chunk_no int, cnt bigint").write.parquet(f"{tmp_path}/sample_counts.parquet")
    spark.createDataFrame([(i,) for i in range(1, 6)], "sample_idx int").write.parquet(f"{tmp_path}/kct_samples.parquet")
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.kmer_bits, r.counts) for r in rows) == [(10, "4,0,0,0,5"), (20, "0,0,0,7,0"), (30, "0,0,0,0,1"), (60, "0,8,0,0,0")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", PUSHES)
def test_pushes_give_the_whole_matrix(spark, name):
    """The SQL of count_matrix_wide builds the vectors over all samples."""
    con = pytest.importorskip("duckdb").connect()
    for t in ("sample_counts", "kct_samples"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["count_matrix_wide"]).fetchall())
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, DATA).select("kmer_bits", "counts").collect()) == want
