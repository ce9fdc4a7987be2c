"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from strataline.plans import atlas, charts, climate, diagnostics, models, ocean, registry, usage  # noqa: F401 (these fill the registry)

DATA = "/root/testdata/sf0.001"


def shown(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, DATA)
    rel = db.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(shown(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    got = sorted(tuple(shown(r[c]) for c in sorted(cols)) for r in df.collect())
    assert got == want
