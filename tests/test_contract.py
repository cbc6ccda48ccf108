"""Registered queries against their SQL on the smallest tables, and rules of the repository."""

import os
import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
import check  # noqa: E402

import __spark_entry__ as contract  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# whole jobs, run at length by tools/check.py
LONG = {"ml_inference_job", "retrain_job", "classify_users", "kmeans_clusters"}

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(set(contract.queries()) - LONG))
def test_query_equals_its_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


@needs_data
def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() > 0 and "criticality" in out.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 110


def test_no_local_checkpoints_cross_joins_or_python_row_functions():
    banned = re.compile(r"localCheckpoint|crossJoin|toPandas|F\.udf|\.rdd\.map")
    for path in (ROOT / "ticketlens").rglob("*.py"):
        assert not banned.search(path.read_text(encoding="utf-8")), path
