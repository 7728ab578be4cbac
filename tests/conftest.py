import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabsense.session import get_session
    ckpt = tempfile.mkdtemp(prefix="tabsense-test-ckpt-")
    s = get_session("local[4]", app_name="tabsense-tests", shuffle_partitions=8,
                    spark__checkpoint__dir=ckpt)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from tabsense.plans.catalog import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
