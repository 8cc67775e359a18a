import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "embeddings events documents benchmark labels pages conversations".split()


def plain(v):
    return None if v != v else v


@pytest.mark.parametrize("name", ["filter_uid_mod", "vec_l2", "topk_exact", "sim_join_band", "tumbling_avg_vec", "itopk_sliding", "events_band_join", "stream_filter_map"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(map(plain, r)) for r in want.fetchall()))) == sorted(repr(tuple(map(plain, r))) for r in got.select(columns).collect())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
