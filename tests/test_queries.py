"""Every query of the engine's own operators against its DuckDB SQL on the smallest tables."""

import pytest

from marketloom.plans import catalog

from .compare import duck, duck_rows, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df)
    if name in catalog.SQL:
        want = duck_rows(con, catalog.SQL[name])
        assert got[0] == want[0]
        assert got[1] == want[1]
