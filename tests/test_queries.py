"""Every query of the engine against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from folioforge import catalog

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.gather()


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(repr([plain(row[c]) for c in order]) for row in df.collect())
    theirs = sorted(repr([plain(row[columns.index(c)]) for c in order]) for row in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, TABLES).limit(1).count() == 1


def events_query(spark, path, name, events):
    """Rows of a query and of its SQL over ``event_id, user_id, event_type``."""
    con = duckdb.connect(config={"threads": 1})  # more do not sort equal ranges alike in both windows of g17's SQL
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", events)
    con.execute(f"COPY events TO '{path}/events.parquet'")
    df, found = QUERIES[name](spark, str(path)), con.execute(SQL[name])
    assert df.columns == [c[0] for c in found.description]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, found.fetchall()))


def test_active_item_of_great_and_odd_numbers(spark, tmp_path):
    events = [(i * 7919 + k * 100_000, i % 5, "view" if i % 2 else "click") for i in range(120) for k in range(12)]
    events += [(11, 1, "click"), (11, 1, "click"), (13, None, "view"), (24, None, "click"), (None, 2, "click"), (None, 2, "view"), (-5, 3, "click"), (-20, 3, "view"), (7, 9, "click")]
    ours, theirs = events_query(spark, tmp_path, "j04_active_item", events)
    assert ours == theirs


def test_merged_ranges_of_equal_and_odd_events(spark, tmp_path):
    events = [(i * 37 + k * 9000, i % 7, "view") for i in range(300) for k in range(3)]
    events += [(None, 1, "view"), (None, 50, "view"), (5, None, "view"), (6, None, "view"), (-5, 3, "view"), (-700, 51, "view"), (-701, 51, "view"), (142, 51, "view")]
    ours, theirs = events_query(spark, tmp_path, "g17_merged_ranges", events)
    assert ours == theirs
