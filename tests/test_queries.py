"""Every registered query against its DuckDB twin, value by value."""

import duckdb
import pytest

from tessella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return v + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols
    assert len(got) == len(want)
    for g, w in zip(got, want):
        # as strict as a hash of the values; floats were rounded on both sides
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-13 * max(1, abs(a))) for a, b in zip(g, w)), (g, w)
