"""Every query against its SQL, over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodegraph.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
    else:
        assert got


def test_few_queries_lack_sql():
    assert {n for n in QUERIES if n not in ORACLES} == {"gr_ground", "gr2_ground", "gr_stop", "pl_answers", "pl_judged", "fn_seq_ratio", "flt_entity_clean", "rr_rate_keys"}


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
