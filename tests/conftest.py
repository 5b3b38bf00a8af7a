import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from epilens import build_session

    session = build_session("local[4]", app_name="epilens-tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_inputs(spark):
    from epilens.plans.analyses import Inputs
    from epilens.sources import read_csv

    ind = read_csv(spark, os.path.join(FIXTURES, "indicator.csv"))
    return Inputs(read_csv(spark, os.path.join(FIXTURES, "cases.csv")), ind, ind)
