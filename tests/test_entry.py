import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_every_query_of_the_statement_engine_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["amount_round_trip", "lot_reconciliation", "block_split", "canonical_union", "explosion_check", "column_clusters"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(DATA):
        db.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    got = entry.queries()[name](spark, DATA)
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_column_clusters_keeps_edges_that_no_bigint_holds(spark, tmp_path):
    values = [3.2, 4.7, float("nan"), float("nan"), float("inf"), float("inf"), 1e19, 1e19, -1e19, -1e19, -8.2, -0.5]
    rows = [(i % 2, v) for v in values for i in range(4)] + [(None, 1.5), (None, 2.5), (None, None)]
    spark.createDataFrame(rows, "user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(ORACLE_SQL["column_clusters"]).fetchall()
    got = [tuple(r) for r in QUERIES["column_clusters"](spark, str(tmp_path)).collect()]
    assert len(want) == 7 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
