import pytest

import __spark_entry__ as entry
from atomspan.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["neighbor_counts", "chebyshev_angular", "msd_lags", "standardize", "first_atom_offsets", "sort_atoms", "formula_parse"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
