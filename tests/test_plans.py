"""Plan shape guards for the library's own operators: no cartesian or
nested-loop joins and no Python evaluation."""

import re

import pytest

import __spark_entry__ as E

QUERIES = {k: v for k, v in E.queries().items() if v.__module__.startswith("paraspark.plans.")}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, sf_small, key):
    plan = QUERIES[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython", plan)


# a row cap is allowed only where it is the operator: first-N preview (C12),
# seeded sample of k (H5), evaluation cap (H6); F17's per-run top-k is a
# window group limit (the newest k-1 checkpoints per run), not a cap on rows
ROW_CAP = {"c12_first_n", "h5_seeded_sample", "h6_eval_cap"}
TOP_K_PER_GROUP = {"f17_kept_checkpoints"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_row_caps(spark, sf_small, key):
    plan = QUERIES[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    if key not in ROW_CAP:
        assert not re.search(r"GlobalLimit|LocalLimit|TakeOrderedAndProject|CollectLimit", plan)
    if key not in TOP_K_PER_GROUP:
        assert "WindowGroupLimit" not in plan
