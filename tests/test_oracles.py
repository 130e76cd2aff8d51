"""Each registered query against the SQL that says the same, on the driver's tables."""

from pathlib import Path

import duckdb
import pytest

from kinetia.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="data not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    return None if x is None or x != x else round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, DIR)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [str(x) for x in r]
    expected = sorted(([cell(x) for x in r] for r in want.fetchall()), key=key)
    got = sorted(([cell(r[c]) for c in names] for r in df.collect()), key=key)
    assert len(got) == len(expected) and all(a == pytest.approx(b, abs=2e-5) if isinstance(a, float) and b is not None else a == b for x, y in zip(got, expected) for a, b in zip(x, y)), [(x, y) for x, y in zip(got, expected) if x != y][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
