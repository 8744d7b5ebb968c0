"""Each query with SQL against DuckDB at the smallest size."""

import numbers
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from pagelattice.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SF, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else str(v)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        wanted = duck.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found)
