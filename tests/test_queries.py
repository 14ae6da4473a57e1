"""Every registered query against its oracle, on the smallest tables."""

from pathlib import Path

import pytest

from ringweave.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, run_pair

SF = "/root/testdata/sf0.001"

ROWS_ONLY = {"coordinate_ascent", "calibrate", "baseline_logistic", "baseline_gbt", "train_challenger", "shadow_opinion", "champion_challenger_agreement"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_model_training_lacks_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    rows, problem = run_pair(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ["coordinate_ascent", "calibrate"])
def test_rows_only_queries_run(spark, con, name):
    rows, _ = run_pair(spark, con, SF, name, QUERIES[name], None)
    assert rows > 0
