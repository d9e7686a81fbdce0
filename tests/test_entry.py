"""The registered queries against their SQL, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"missing_years"}))
def test_gives_rows_and_no_row_twice(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    rows = [repr(r) for r in df.collect()]
    assert rows and len(df.columns) == len(set(df.columns))
    if name.endswith("_found") or name.startswith(("burst", "note_", "stripped")):
        assert len(rows) == len(set(rows))


def test_missing_years_by_the_instants(spark):
    us = [r.instant_us for r in entry.queries()["p3_found"](spark, str(DATA)).filter("tbl = 'parsed_notes'").collect()]
    have = {datetime.datetime.fromtimestamp(u // 10**6, datetime.timezone.utc).year for u in us}
    got = [r.year for r in entry.queries()["missing_years"](spark, str(DATA)).collect()]
    assert sorted(got) == [y for y in range(min(have), max(have)) if y not in have]


def test_embeddings_by_hand(spark):
    bodies = {r.id: r.body for r in spark.read.parquet(f"{DATA}/retrieval_units.parquet").collect()}
    for r in entry.queries()["embeddings_of_units"](spark, str(DATA)).collect():
        b = bodies[r.id].encode()
        v = [sum(x % 97 / 97 for x in b[i::64]) for i in range(64)]
        n = math.sqrt(sum(x * x for x in v))
        assert r.dims == 64 and abs(r.norm - 1) < 1e-3 and all(abs(x - y / n) < 1e-5 for x, y in zip(r["first"], v))
