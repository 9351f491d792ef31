"""Every catalog query against its SQL statement on the smallest tables."""

import os

import duckdb
import pytest
from tables import SMALL

from anchorline.catalog import load

QUERIES, ORACLES = load()


def plain(rows):
    return sorted(tuple("NULL" if v is None else repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    want = db.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain([r[i] for i in at] for r in want.fetchall())


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
