import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ringlens.session import local_session

    s = local_session(cpus=4, shuffle_partitions=8, app="ringlens-tests")
    yield s
    s.stop()


@pytest.fixture
def calls_df(spark):
    """Hand-made call rows: build a DataFrame from tuples of the raw call schema."""
    schema = ("call_id long, campaign_id string, name string, target_id long, call_url string, connected boolean, "
              "disconnected_reason string, duration_ms string, transcript string, post_call_analysis string, "
              "executed_at string")

    def make(rows):
        return spark.createDataFrame(rows, schema)
    return make
