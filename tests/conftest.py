import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from check import session
    return session("4")


@pytest.fixture()
def rows(spark):
    """Build a DataFrame from tuples and a DDL schema."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make


CONN = "event_id long, us long, src_ip string, dst_ip string, dst_port int, protocol string, flags string, size long"
DNS = "event_id long, us long, src_ip string, query_name string, query_type string, is_nxdomain boolean, response_ip string"
ARP = "event_id long, us long, op int, src_ip string, src_mac string"
AUTH = "event_id long, us long, src_ip string, usr string, event_kind string, command string"
S = 1_000_000
T0 = 1_704_153_600 * S  # 2024-01-02 00:00 UTC
