"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from chronolens.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def canon(rows, columns):
    out = []
    for r in rows:
        out.append(tuple("NULL" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in (r[c] for c in columns)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name]).df()
    assert columns == sorted(want.columns)
    a = canon((r.asDict() for r in got.collect()), columns)
    b = canon(want.astype(object).to_dict("records"), columns)
    assert len(a) == len(b)
    near = [x for x in zip(a, b) if x[0] != x[1]]
    assert all(u == v or abs(float(u) - float(v)) <= 2e-5 for x, y in near for u, v in zip(x, y)), near[:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
