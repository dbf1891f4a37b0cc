"""Twins on rows that the small tables lack: ties at edges, no room for negatives, files in any order, sessions that are closed early."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from tests.conftest import SF, same

from gavel import catalog
from gavel.operators.order import quantiles
from gavel.sources import logs

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def test_a_quantile_between_equal_values_is_their_value(spark):
    df = spark.range(60).select(F.col("id").alias("k"), ((F.col("id") + 1) / 1200.0).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("_i"))
    got = quantiles(df, "v", [i / 10 for i in range(11)], ("k",)).collect()
    assert len(got) == 660 and all(r.edge == (r.k + 1) / 1200.0 for r in got)


def test_positives_may_fill_the_table(spark, tmp_path):
    big = "/root/testdata/sf0.1"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{big}/lineitem.parquet'")
        want = con.execute(ORACLES["p6_keep_positives"]).df()
    assert 0 in set(want["n"])
    same(QUERIES["p6_keep_positives"](spark, big).toPandas(), want)


def test_first_rows_are_those_of_an_order(spark, tmp_path):
    path, order = f"{SF}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
    spark.read.parquet(path).repartition(5, "l_suppkey").sortWithinPartitions(F.desc("l_orderkey")).write.parquet(str(tmp_path / "turned"))
    first = lambda p: logs.first_rows(spark, p, 50, {"l_quantity": (25.0, 14.0), "l_discount": (0.05, 0.03)}, order)
    same(first(str(tmp_path / "turned")).toPandas(), first(path).toPandas())


def test_a_closed_session_takes_no_later_events(spark, tmp_path):
    """User 7's session is closed when an event of its time comes a part later, which is not late itself; user 8's gap is just 12 hours."""
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(1, at(0), 1), (2, at(24 * 19 + 23), 1), (3, at(24 * 3 + 23), 2), (4, at(24 + 10), 7), (97, at(24 + 20), 7)]
    rows += [(5, at(24), 8), (6, at(36), 8), (8, at(24 * 9), 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.execute(ORACLES["z6_spanning_sessions"]).df()
    got = QUERIES["z6_spanning_sessions"](spark, str(tmp_path)).toPandas()
    same(got, want)
    assert sorted(got[got["user_id"] == 7]["n"]) == [1, 1] and list(got[got["user_id"] == 8]["n"]) == [2]
