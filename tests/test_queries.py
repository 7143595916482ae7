"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, sql, name):
    df = catalogue.queries()[name](spark, small)
    got = canonical(df.columns, df.collect())
    if name in ORACLES:
        found = sql.execute(ORACLES[name])
        assert got == canonical([c[0] for c in found.description], found.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_number_functions_of_values_at_and_below_zero(spark, small, tmp_path):
    """No value above 0 gives null, in the query as in its SQL."""
    events = spark.read.parquet(f"{small}/events.parquet").limit(4)
    values = "CASE event_id % 4 WHEN 0 THEN 0.0D WHEN 1 THEN 0.5D WHEN 2 THEN 50.0D ELSE 51.0D END"
    events.selectExpr("* except (value, event_id)", "monotonically_increasing_id() AS event_id").selectExpr("*", f"{values} AS value").write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.queries()["number_functions"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(ORACLES["number_functions"])
    assert canonical(df.columns, df.collect()) == canonical([c[0] for c in found.description], found.fetchall())
    assert {r["positive"] for r in df.collect()} == {None, 0.5, 50.0, 1.0}
