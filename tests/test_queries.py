"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from weftline.plans import catalog  # noqa: E402

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def tidy(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5f}"
        if isinstance(v, (list, tuple)):
            return str([one(x) for x in v])
        return f"{float(v):.5f}" if isinstance(v, int) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(SQL[name])
    assert columns == sorted(d[0] for d in want.description)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})")
    assert tidy(got.select(*columns).collect()) == tidy(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
