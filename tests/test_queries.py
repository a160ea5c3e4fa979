"""Every registered query of the bars part against its SQL."""

import datetime
import random

import duckdb
import pytest
from oracles import assert_same, connect

from candlewick.plans import queries

ORACLE = queries.oracle_sql()
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLE[name])


@pytest.fixture(scope="module")
def below_zero(spark, tmp_path_factory):
    """Events whose walks cross zero, as those of 60 copies of sf0.1 do."""
    rng, start, folder = random.Random(5), datetime.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("below"))
    kinds = "view click error purchase signup".split()
    rows = [(k, start + datetime.timedelta(minutes=12 * (k // 5)), kinds[k % 5], round(50 + rng.gauss(0, 7000), 2)) for k in range(15_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["top_cells", "label_grid_best", "label_grid_full", "label_grid_long", "label_grid_long_full", "label_grid_long_short"])
def test_grid_equals_sql_below_zero(spark, below_zero, name):
    folder, con = below_zero
    assert con.sql(f"SELECT min(low) < 0 AND max(low) > 0 FROM ({ORACLE['bars_walk']})").fetchall() == [(True,)]
    assert_same(QUERIES[name](spark, folder), con, ORACLE[name])


@pytest.fixture(scope="module")
def through_zero(spark, tmp_path_factory):
    """Events whose hours close at exactly zero, also twice running, in the whole series and in its part val."""
    rng, start, folder = random.Random(3), datetime.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("zero"))
    rows, zeros = [], 0
    for kind in "view click error purchase signup".split():
        prices = [rng.randint(-6, 9) for _ in range(400)]
        zeros += sum(p == q == 0 for p, q in zip(prices[280:339], prices[281:340]))
        steps = [(p - q) * 50_000 for p, q in zip(prices, [100, *prices])]
        rows += [(len(rows) + k, start + datetime.timedelta(hours=k), kind, (step + 5000) / 100) for k, step in enumerate(steps)]
    assert zeros > 0
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["label_grid_best", "label_grid_full", "label_grid_long", "label_grid_long_full", "label_grid_long_short"])
def test_grid_equals_sql_through_zero(spark, through_zero, name):
    folder, con = through_zero
    assert con.sql(f"SELECT count(*) > 0 FROM ({ORACLE['bars_walk']}) WHERE close = 0").fetchall() == [(True,)]
    assert_same(QUERIES[name](spark, folder), con, ORACLE[name])


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_rows_only_queries(spark, sf):
    assert QUERIES["model_score"](spark, sf).where("abs(p_sell + p_hold + p_buy - 1) > 2e-6").count() == 0
    assert QUERIES["trial_grid"](spark, sf).count() == 4
