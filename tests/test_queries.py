"""Every registered query gives the rows of its SQL on the small tables."""

import duckdb
import pytest

from eventloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

catalog.load()


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, views, name):
    got = catalog.QUERIES[name](spark, small)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.SQL:
        want = views.execute(catalog.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())
