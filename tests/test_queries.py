"""Every query of the fact graph that has SQL, against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

from factloom.operators import people
from factloom.plans import queries as plans


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, sf_dir, duck, name):
    made = plans.QUERIES[name](spark, sf_dir)
    want = duck.sql(plans.SQL[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    asked = sorted(tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in made.collect()) == asked


# Instants of events in seconds; a mean of their ends that isn't rounded as in SQL is a second less (or more) than the second one.
ENDS = [(100.6, 201.0, 301.0), (100.0, 201.0, 301.5), (100.5, 201.0, 301.0), (-100.0, -51.0, -3.0), (-100.5, -52.0, -3.6), ()]


def held_at_ends(spark, tmp_path, name, ends):
    """Rows of a query, and of its SQL, over a user's events at ``ends``."""
    rows = [(k, 1, "view", float(k), round(at * 1e6)) for k, at in enumerate(ends, 1)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, at long")
    events.selectExpr("event_id", "user_id", "event_type", "value", "timestamp_micros(at) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(plans.SQL[name])
    columns = want.columns
    return sorted(tuple(r[c] for c in columns) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()), sorted(want.fetchall())


@pytest.mark.parametrize("ends", ENDS)
def test_sets_as_of_the_middle_of_instants_with_fractions(spark, tmp_path, ends):
    got, want = held_at_ends(spark, tmp_path, "g_asof_many", ends)
    assert got == want


@pytest.mark.parametrize("ends", ENDS)
def test_values_as_of_the_middle_of_instants_with_fractions(spark, tmp_path, ends):
    got, want = held_at_ends(spark, tmp_path, "g_asof_one", ends)
    assert got == want


def test_strangers_of_stored_links_are_no_persons_however_long_the_table_is(spark, tmp_path):
    rows = [(7, "hot bolt", 1), (8, "hot bolt", 2), (1_000_007, "hot bolt", 2), (1_000_008, "hot bolt", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(plans.SQL["id_state"] + " ORDER BY ALL")
    assert ("a", "b", "state") == tuple(want.columns) and (7, 1_000_007, "unfounded") in want.fetchall()
    assert sorted(map(tuple, plans.QUERIES["id_state"](spark, str(tmp_path)).collect())) == want.fetchall()


def test_groups_of_evidence_keep_estimates_small(spark, sf_dir, capsys):
    found = people.evidence_groups(plans.persons(spark, sf_dir))
    capsys.readouterr()
    found.explain("cost")
    assert re.search(r"sizeInBytes=[\d.]+ (B|KiB)", capsys.readouterr().out)
