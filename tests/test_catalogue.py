"""Registered queries against their SQL, at the smallest scale."""

import os

import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# One query per area; `python -m checks.compare` runs all of them.
CHOSEN = [
    "s1_read_requests", "s3_publish_raw", "s7_reject_records", "v3_hmac_verify", "v3d_hmac_policy",
    "v7_classify_request", "v8_validate_raw", "v11_check_processed", "p6_to_processed",
    "p8_parse_referrer_shuffled", "p9_session_signature_shuffled", "p10_filter_query_params", "p11_rewrite_forward_query", "p12_trace_context",
    "p13_request_log_row", "k2_get_or_create_salts", "k8_cleanup_salts", "m1_outcome_counts",
    "t4_batch_proxy_mode", "t5_admission_outputs",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLES) and len(ORACLES) == 55


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, tables, name):
    assert difference(spark, tables, SF_DIR, name) is None
