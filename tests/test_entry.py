import pytest

import __spark_entry__ as entry
from priorframe.queries import load
from priorframe.streaming import live

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(load()[0]) > 150


@pytest.mark.parametrize("name", ["live_latest_state", "closing_line_stream", "windowed_stream"])
def test_streams_replay_like_batches(spark, name):
    import duckdb

    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{SF}/events.parquet')")
    want = con.execute(sql[name]).fetchdf()
    got = queries[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, want.astype(str).itertuples(index=False))) == sorted(map(str, got.astype(str).itertuples(index=False)))


def test_work_dir_is_under_the_shared_folder(spark):
    folder = live.work_dir(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
