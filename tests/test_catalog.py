"""Every query against its SQL, as the driver compares them."""

import duckdb
import pytest

from foliant.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows
    if name not in catalog.ORACLES:
        return
    sql = con.sql(catalog.ORACLES[name])
    columns = sorted(sql.columns)
    assert columns == sorted(got.columns)
    order = [sql.columns.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in sql.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    for a, b in zip(rows, wanted, strict=True):
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(y, float) and x is not None else x == y for x, y in zip(a, b, strict=True)), (a, b)
