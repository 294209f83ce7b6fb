import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from millwright.session import local_session

    s = local_session(cores=8, shuffle_partitions=8, app="millwright-tests")
    yield s
    s.stop()


def readings_df(spark, rows):
    """Readings from (rpm, torque, wear, air, process, type) tuples; udi = position."""
    data = [(i, str(i), t, float(a), float(p), float(r), float(q), float(w))
            for i, (r, q, w, a, p, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "udi bigint, product_id string, type string, air_temp_k double, process_temp_k double, "
              "rpm double, torque_nm double, tool_wear_min double")
