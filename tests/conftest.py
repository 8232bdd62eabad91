import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillroll.session import local_session
    s = local_session("*", 8, app_name="tillroll-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lines(spark):
    from tillroll.sources.testbed import sales_lines
    return sales_lines(spark, SF_SMALL)


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
