"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

from evidenceframe.plans.registry import all_oracles, all_queries

from .conftest import SF, same_rows

ORACLES = all_oracles()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    if name in ORACLES:
        same_rows(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(all_queries())


def test_flagship_runs_in_one_exchange(spark):
    plan = all_queries()["quality_weighted_patient"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["box_overlap", "localization_hits", "parse_records", "majority_vote_patient", "classification_report", "roc_auc", "bootstrap_paired", "nested_protocol"])
def test_no_python_in_plan(spark, name):
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
