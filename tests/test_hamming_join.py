"""The join of hashes within some bits stays a sort merge join, however small its sides look."""

from stratalens.plans import registry
from tests.test_findings_r02 import SF


def test_hsh06_broadcasts_no_side(spark):
    plan = registry.QUERIES["hsh06_hamming"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
