import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

FAST = [
    "read_optional", "to_num", "pad_fips", "discharge_flags", "extract_snippet", "icu_anchor", "poa_cancer", "dx_flags",
    "cancer_icu_broad", "anchored_interval_join", "lab_flags", "vital_features", "phenotype_summary_counts",
    "burden_yearly", "summarise_continuous", "ntile_quartile", "exposure_quartiles", "pm25_yll_quartiles",
    "logistic_model_two_by_two", "linear_model_one_regressor", "encounter_level", "review_queue", "inpatient_cohort",
    "table_one_patient", "lab_summary", "stitch_encounters", "waterfall_fill", "top_k_per_group",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name).startswith("equal")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 140


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["phenotype_summary_counts", "encounter_level", "exposure_quartiles", "lab_summary", "stitch_encounters"])
def test_plans_have_no_python_and_no_single_task_window(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "EvalPython" not in text and "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text or "Window" not in text


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    text = plan(spark, sf_dir, "adult_filter")
    assert "o_totalprice" not in text and "PushedFilters" in text
