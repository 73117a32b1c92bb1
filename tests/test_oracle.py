"""Every query of the library against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from meridian.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    """Equal rows, whole numbers exactly and others to 11 significant digits or, near 0, absolutely."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)

    def shown(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        return f"{float(x):.11g}" if isinstance(x, float) and abs(x) > 1e-9 else "0" if isinstance(x, float) else str(x)

    def rows(d):
        return sorted(tuple(map(shown, r)) for r in d[cols].itertuples(index=False))

    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        same(found, con.sql(registry.ORACLE[name]).df())
    else:
        assert len(found)
