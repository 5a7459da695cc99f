"""Every query of the engine's own operators against its SQL in DuckDB, over the smallest test tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from bitquarry import catalog

duckdb = pytest.importorskip("duckdb")

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    df = catalog.queries()[name](spark, str(DATA))
    cursor = connection.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_every_query_but_the_order_dependent_ones_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= {"o4_picture_buffer", "m9_stream_poc", "m9_stream_sets"} | {n for n in catalog.queries() if n.startswith("e")}
