"""The fixtures make rules bite: each flag or status of a registered rule takes more than one value."""

import pytest

from compare import duck
from jobsift.plans import registry

registry.load_all()
RULES = {"errors_5m": "unhealthy", "errors_1h": "alert", "errors_1h_stream": "alert", "error_burst": "burst", "no_new_24h": "alert", "no_new_24h_stream": "alert",
         "health_status": "status", "no_new_timer": "event", "stream_stop": "status", "stream_stop_streak": "alert", "failure_streak": "alert"}


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(RULES))
def test_both_outcomes(con, name):
    assert con.sql(f"SELECT count(DISTINCT {RULES[name]}) FROM ({registry.ORACLE[name]})").fetchall()[0][0] > 1
