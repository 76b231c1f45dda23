"""Every registered query of the library against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tabulon.plans import catalogue

DIR = next((p for p in ("/root/testdata/sf0.001",) if Path(p).is_dir()), None)
pytestmark = pytest.mark.skipif(DIR is None, reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-4) for u, v in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.SQL:
        assert got
        return
    said = duck.execute(catalogue.SQL[name])
    cols, want = [c[0] for c in said.description], said.fetchall()
    assert sorted(df.columns) == sorted(cols)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = ([tuple(round(float(v), 4) if isinstance(v, float) else v for v in (r[c.index(k)] for k in sorted(c))) for r in data] for c, data in ((df.columns, got), (cols, want)))
    assert same(sorted(a, key=key), sorted(b, key=key)), (sorted(a, key=key)[:3], sorted(b, key=key)[:3])
