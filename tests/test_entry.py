"""The entry module: registered names, and every query that has SQL against it, on the smallest tables."""

import re
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__
from loomtext import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
GROUPS = 8


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())


def compared(spark, name):
    """What differs, or none."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    try:
        df = catalog.QUERIES[name](spark, DIR)
        found = con.sql(catalog.ORACLE_SQL[name])
        if sorted(df.columns) != sorted(found.columns):
            return f"{name}: columns {df.columns}, {found.columns}"
        rounded = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
        got, want = (sorted(map(repr, map(rounded, rows))) for rows in (df.select(*found.columns).collect(), found.fetchall()))
        return None if got == want else f"{name}: {len(got)} rows, {len(want)}; {next(((a, b) for a, b in zip(got, want) if a != b), '')}"
    except Exception as error:  # noqa: BLE001
        return f"{name}: {error}"[:500]


@pytest.mark.parametrize("group", range(GROUPS))
def test_queries_equal_sql(spark, group):
    names = sorted(catalog.ORACLE_SQL)[group::GROUPS]
    with ThreadPoolExecutor(4) as pool:  # small jobs, most of whose time is planning
        assert list(filter(None, pool.map(lambda name: compared(spark, name), names))) == []


def test_all_queries_read_whole_tables():
    """No filters on ids that make a check cheap."""
    sql = " ".join(catalog.ORACLE_SQL.values())
    assert not re.search(r"vec_id < \d|doc_id % \d+ = \d+ and", sql)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 120
