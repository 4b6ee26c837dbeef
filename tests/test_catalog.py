"""Every query of the library beside its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from voxlake.plans import catalog, catalog_files, catalog_fits, catalog_lattice, catalog_meters, catalog_more, catalog_scans, catalog_solve  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(row):
    return tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(plain(r[c] for c in columns) for r in df.collect())
    assert got or name == "f30_tiling_summary"
    if name in catalog.ORACLE_SQL:
        result = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(plain(r[i] for i in order) for r in result.fetchall())
