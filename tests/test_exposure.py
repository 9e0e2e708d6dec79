import pytest
from pyspark.sql import functions as F

import study_queries as sq
from cohortspark.plans import exposure
from cohortspark.sources import io


def panel(spark, rows):
    return spark.createDataFrame(rows, "GEOID string, year int, pm25_mean double, pm25_filled_2024 boolean")


def test_lookup_pads_and_caps(spark):
    got = exposure.exposure_lookup(panel(spark, [("1001", 2024, 8.0, True), ("17031", 2025, 9.0, False)]), exposure.PM25_COLUMNS)
    assert [tuple(r) for r in got.collect()] == [("01001", 2024, 8.0, True)]


def test_repeated_panel_key_is_rejected(spark):
    data = spark.createDataFrame([("H1", "1001", 2020, 1)], "hospitalization_id string, county_code string, icu_year int, icu_month int")
    twice = panel(spark, [("1001", 2020, 8.0, False), ("01001", 2020, 9.0, False)])
    no2 = spark.createDataFrame([], "GEOID string, year int, no2_mean double")
    svi = spark.createDataFrame(
        [], "GEOID string, year int, year_release int, svi_overall double, svi_theme1 double, svi_theme2 double, "
        "svi_theme3 double, svi_theme4 double")
    with pytest.raises(ValueError, match="repeats"):
        exposure.exposome_link(data, twice, no2, svi)
    assert exposure.exposome_link(data, twice, no2, svi, strict=False).count() == 2


@pytest.fixture(scope="module")
def cases(spark, sf_dir):
    return io.materialize(sq.probable(spark, sf_dir))


def test_attributable_years(cases):
    patients = exposure.attributable_yll_patient(cases).persist()
    row = patients.agg(F.min("attributable_excess_yll"), F.max("predicted_mortality_observed"), F.count("*")).first()
    assert row[0] >= 0 and row[1] < 1 and row[2] >= exposure.MIN_MODEL_ROWS
    same = patients.filter(F.abs(F.col("pm25_annual") - F.col("pm25_reference")) < 1e-12)
    assert (same.agg(F.max("attributable_excess_yll")).first()[0] or 0) == 0
    yearly = exposure.attributable_yll_yearly(patients).agg(F.sum("attributable_excess_yll")).first()[0]
    total = exposure.attributable_yll_summary(patients).first().total_attributable_excess_yll
    assert yearly == pytest.approx(total)


def test_no_model_leaves_baseline_only(spark, cases):
    few = cases.limit(20)
    assert exposure.attributable_yll_patient(few) is None
    baseline = exposure.pm25_baseline_yll_yearly(cases, exposure.pm25_yll_quartiles(cases))
    for r in exposure.pm25_yll_yearly(baseline, None).collect():
        assert r.attributable_excess_yll == 0 and r.total_yll_with_excess == r.baseline_yll


def test_reference_falls_back_to_lower_quartile(spark):
    rows = [(f"H{i}", 1, float(i), "Q3", 50) for i in range(5)]
    df = spark.createDataFrame(rows, "hospitalization_id string, phenotype_primary int, pm25_annual double, pm25_q string, age_at_admission int")
    assert exposure.pm25_reference(df).first().ref == 1.0
    none = df.withColumn("pm25_annual", F.lit(None).cast("double"))
    assert exposure.pm25_reference(none).first().ref is None


def test_quartile_without_q1_has_no_baseline(spark):
    rows = [("Q2", 1, 10.0), ("Q2", 0, 20.0), ("Q3", 0, 20.0)]
    df = spark.createDataFrame(rows, "pm25_q string, hospital_mortality int, yll_if_death double")
    got = {r.pm25_q: r for r in exposure.pm25_yll_quartiles(df).collect()}
    assert got["Q2"].total_yll_observed == 10.0 and got["Q2"].excess_total_yll_vs_q1 is None
    assert got["Q3"].mean_yll_per_death is None
