"""The samples' queries on a table whose last samples lack channels, against their SQL."""

import os

import duckdb
import pytest

from fieldgrid.plans import queries, sql

QUERIES = ["assemble_tensor", "bucketed_pairs", "channel_layers", "dataset_shape", "field_magnitude", "head_sample_magnitude", "irfft2_batches", "residual_block", "rfft2_batches", "rfft2_rows", "spectral_conv_batches", "tensor_roundtrip"]


@pytest.fixture(scope="module")
def ragged(tmp_path_factory, small):
    """Sample 3 lacks its first channel, 4 its second, 5 both; 6 has the first, 7 all but the last, and 8 the first two alone."""
    at = tmp_path_factory.mktemp("ragged")
    gone = (12, 17, 20, 21, 25, 26, 27, 31, 34, 35)
    duckdb.sql(f"SELECT * FROM '{small}/embeddings.parquet' WHERE vec_id < 36 AND vec_id NOT IN {gone}").write_parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_samples_that_lack_channels(name, spark, ragged):
    con = duckdb.connect()
    for f in os.listdir(ragged):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ragged}/{f}'")
    cur = con.execute(sql.oracle_sql()[name])
    names = sorted(x[0] for x in cur.description)
    want = sorted((tuple(dict(zip([x[0] for x in cur.description], r))[c] for c in names) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in names) for r in queries.queries()[name](spark, ragged).collect()), key=repr)
    assert got == want and got


def test_scores_of_samples_that_lack_channels(spark, ragged, small):
    whole = {r.sample_ix: r for r in queries.operator_score(spark, small).where("sample_ix < 9").collect()}
    got = {r.sample_ix: r for r in queries.operator_score(spark, ragged).collect()}
    assert set(got) == set(range(9))
    assert [got[k].n for k in range(9)] == [128, 128, 128, 0, 0, 0, 0, 64, 0]
    assert all(got[k] == whole[k] for k in range(3)) and got[7].mse is not None
    assert all(got[k].mse is None for k in (3, 4, 5, 6, 8))
