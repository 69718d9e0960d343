import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillframe.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="quillframe-tests")
    yield s
    s.stop()


def one(spark, col, schema="t string", rows=None):
    """Evaluate a Column expression over literal rows; returns the list of values."""
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]
