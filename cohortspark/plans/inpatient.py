"""Inpatient cohort by date range, cohort-filtered tables, and descriptive tables of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_at_date, parse_dt, whole_days_between
from ..functions.semantics import known
from ..operators.anchors import KEY, ids_ever
from ..operators.outliers import replace_outliers
from ..operators.quantiles import percentile_table
from ..operators.summaries import categorical_table, category_summary
from .phenotype import adult_filter

# Study dates and variables of the descriptive tables.
START_DATE = "2020-01-01"
END_DATE = "2021-12-31"
INPATIENT_LOCATIONS = ["Ward", "ICU"]
PATIENT_CATEGORIES = ["sex_category", "race_category", "ethnicity_category", "language_name"]
PATIENT_NUMBERS = ["age", "n_hospitalizations"]
STAY_CATEGORIES = [
    "discharge_category", "admission_type_name", "race_category", "sex_category", "ethnicity_category",
    "language_name",
]
STAY_NUMBERS = ["age_at_admission", "length_of_stay"]


def date_range_cohort(hospitalization: DataFrame, start: str = START_DATE, end: str = END_DATE) -> DataFrame:
    """Admissions from ``start`` through midnight at the beginning of ``end``."""
    admitted = parse_dt(hospitalization, "admission_dttm")
    return hospitalization.filter(
        (admitted >= F.lit(start).cast("timestamp_ntz")) & (admitted <= F.lit(end).cast("timestamp_ntz"))
    )


def eligible_admissions(
    hospitalization: DataFrame, start: str = START_DATE, end: str = END_DATE, include_pediatric: bool = False
) -> DataFrame:
    in_range = date_range_cohort(hospitalization, start, end)
    return in_range if include_pediatric else adult_filter(in_range)


def category_ids(adt: DataFrame, locations: list[str] = INPATIENT_LOCATIONS) -> DataFrame:
    """Ids with a segment at a location (as written, case-sensitive)."""
    return ids_ever(adt, F.col("location_category").isin(*locations))


def er_death_ids(hospitalization: DataFrame, adt: DataFrame) -> DataFrame:
    """Admissions that only ever were in the emergency room and ended in death."""
    only_er = (
        adt.groupBy(KEY)
        .agg(F.min(known(F.col("location_category") == "ER").cast("int")).alias("only_er"))
        .filter(F.col("only_er") == 1)
    )
    return (
        hospitalization.filter(F.col("discharge_category") == "Expired")
        .join(only_er, KEY, "left_semi")
        .select(KEY)
        .distinct()
    )


def id_union(*ids: DataFrame) -> DataFrame:
    out = ids[0]
    for other in ids[1:]:
        out = out.union(other)
    return out.distinct()


def inpatient_cohort(
    hospitalization: DataFrame,
    adt: DataFrame,
    start: str = START_DATE,
    end: str = END_DATE,
    include_pediatric: bool = False,
    include_er_deaths: bool = True,
) -> DataFrame:
    """Ids of eligible admissions with a ward or ICU segment, plus emergency-room deaths of any date and age."""
    eligible = eligible_admissions(hospitalization, start, end, include_pediatric)
    ids = eligible.join(category_ids(adt), KEY, "left_semi").select(KEY)
    return id_union(ids, er_death_ids(hospitalization, adt)) if include_er_deaths else ids.distinct()


def semi_filter(table: DataFrame, ids: DataFrame, key: str = KEY, columns: list[str] | None = None) -> DataFrame:
    kept = table.join(ids.select(key), key, "left_semi")
    return kept.select(*columns) if columns else kept


def filter_tables(
    tables: Mapping[str, DataFrame], cohort_ids: DataFrame, eligible: DataFrame
) -> dict[str, DataFrame]:
    """Every table cut to the cohort; patients by the eligible admissions."""
    return {
        name: semi_filter(table, eligible, "patient_id") if name == "patient" else semi_filter(table, cohort_ids)
        for name, table in tables.items()
    }


def admits_per_patient(hospitalization: DataFrame) -> DataFrame:
    return hospitalization.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_hospitalizations"))


def describe_table(
    df: DataFrame,
    categories: list[str],
    numbers: list[str],
    by: list[str] | None = None,
) -> DataFrame:
    """Levels with n and percent, numbers with median and quartiles, in one long table."""
    by = by or []
    levels = categorical_table(df, categories, by).select(
        *by, "variable", "level", "n", "pct", *[F.lit(None).cast("double").alias(c) for c in ("median", "p25", "p75")]
    )
    rows = percentile_table(df, numbers, [0.25, 0.5, 0.75], by).select(
        *by, "variable", F.lit(None).cast("string").alias("level"), F.col("__n").alias("n"), F.lit(None).cast("double").alias("pct"),
        F.col("p")[1].alias("median"), F.col("p")[0].alias("p25"), F.col("p")[2].alias("p75"),
    )
    return levels.unionByName(rows)


def table_one_patient(patients: DataFrame, hospitalization: DataFrame, start: str = START_DATE) -> DataFrame:
    data = patients.join(admits_per_patient(hospitalization), "patient_id", "left").withColumn(
        "age", age_at_date(F.to_date("birth_date"), F.lit(start).cast("date"))
    )
    return describe_table(data, PATIENT_CATEGORIES, PATIENT_NUMBERS)


def table_one_hospitalization(hospitalization: DataFrame, patients: DataFrame, adt: DataFrame) -> DataFrame:
    """Admission and patient characteristics by whether the admission ever was in the ICU."""
    ever_icu = category_ids(adt, ["ICU"]).withColumn("ever_icu", F.lit(1))
    los = whole_days_between(parse_dt(hospitalization, "admission_dttm"), parse_dt(hospitalization, "discharge_dttm"))
    data = (
        hospitalization.withColumn("length_of_stay", los)
        .join(patients.select("patient_id", *PATIENT_CATEGORIES), "patient_id", "left")
        .join(ever_icu, KEY, "left")
        .fillna(0, subset=["ever_icu"])
    )
    return describe_table(data, STAY_CATEGORIES, STAY_NUMBERS, ["ever_icu"])


def clean_summary(df: DataFrame, limits: DataFrame, category: str, value: str) -> DataFrame:
    """Summary per category after outliers were removed."""
    return category_summary(replace_outliers(df, limits, category, value), category, value)
