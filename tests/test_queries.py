"""Every query against its SQL on the smallest tables."""

import pytest
from support import DATA, alike

from chronospark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        alike(got, duck.execute(ORACLE_SQL[name]).fetchdf())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["returns", "log_returns", "take_log"])
def test_zeros_against_sql(spark, tmp_path, name):
    """Nulls and NaN are unlike here: 0 after 0 is NaN in SQL, a row without one before is null."""
    import duckdb

    # 9.63 / 6.4 - 1 lies just under a tie of rounding
    values = [0.0, 0.0, 0.0, 2.5, 0.0, 6.4, 9.63, 50.0, 0.0, 0.0]
    rows = [(i, i, values[i % 10]) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, at long, value double").selectExpr("event_id", "CAST(timestamp_seconds(at) AS timestamp_ntz) AS ts", "value", "'view' AS event_type")
    df.write.parquet(f"{tmp_path}/events.parquet")
    QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL[name]}")
    columns = ", ".join(con.execute("SELECT * FROM want LIMIT 0").fetchdf().columns)
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM '{tmp_path}/got/*.parquet'")
    assert len(con.execute("SELECT * FROM want").fetchall()) == 60
    assert not con.execute("SELECT * FROM got EXCEPT ALL SELECT * FROM want").fetchall()
    assert not con.execute("SELECT * FROM want EXCEPT ALL SELECT * FROM got").fetchall()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
