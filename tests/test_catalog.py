"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from reposift.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.execute(f"describe {catalog.ORACLES[name]}").fetchall()
    assert {k: KINDS[v] for k, v in df.dtypes} == {r[0]: r[1] for r in want}
    order = [r[0] for r in want]
    plain = lambda rows: sorted((tuple(f"{x:.6f}" if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(df.select(*order).collect()) == plain(duck.execute(catalog.ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["d5_digest", "c6_semantic", "y14_sync_report", "v5_batch_search", "g2_tag_facets"])
def test_result_does_not_depend_on_partitioning(spark, name, monkeypatch):
    from reposift.plans import fixtures

    load = fixtures.load
    found = []
    for n in (1, 7):
        monkeypatch.setattr(fixtures, "load", lambda s, d, t, n=n: load(s, d, t).repartition(n))
        found.append(sorted(map(repr, catalog.QUERIES[name](spark, SF_DIR).collect())))
    assert found[0] == found[1]
