"""Every registered query against its comparison SQL on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import compare  # noqa: E402

from sparkwarden.plans.all_queries import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


# Queries on the merged findings repeat the same audit; two of them stand for all unless ALL_QUERIES is set.
_REPEATED = {n for n, q in QUERIES.items() if q.__module__.endswith("queries_findings")} - {"audit_changed_files", "sarif_report"}
NAMES = [n for n in QUERIES if os.environ.get("ALL_QUERIES") or n not in _REPEATED]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    rows, problems, _, _ = compare.compare(spark, connection, name, QUERIES[name], ORACLES[name], SF)
    assert problems == []
    # The smallest documents hold no secret at all.
    assert rows > 0 or name in ("secrets_in_texts", "secrets_by_severity", "rule_matches_unicode")
