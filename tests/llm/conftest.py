import os

import duckdb
import pytest

from castwise.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck_llm():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return con
