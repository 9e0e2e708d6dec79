"""Burden rates, descriptive tables and years of life lost, all from the analysis table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import remaining_life_expectancy
from ..functions.semantics import count_where, ratio, sum_or_zero
from ..operators.quantiles import exact_percentiles, null_safe_join, scalar_percentiles
from ..operators.summaries import binary_table, continuous_table
from .phenotype import ORGAN_MODULES, TIERS

DENOMINATOR = "cancer_icu_broad"
SHORT = ["possible", "probable", "high_confidence"]

# Variables of the descriptive tables.
BINARY_OUTCOMES = [
    "hospital_mortality", "any_imv", "any_vasopressor", "any_crrt", "prolonged_hospital_los",
    "prolonged_icu_los", "home_discharge", "facility_discharge", "hospice_discharge",
]
CONTINUOUS_OUTCOMES = ["hospital_los_days", "icu_los_days", "age_at_admission"]
TABLE1_BINARY = [
    "any_imv", "any_vasopressor", "any_crrt", "any_steroid", "any_rescue_immunosuppression", *ORGAN_MODULES,
]
TABLE1_CONTINUOUS = [
    "age_at_admission", "n_irae_modules", "ferritin_max", "crp_max", "troponin_max", "creat_max", "lactate_max",
]


def with_exposure(data: DataFrame) -> DataFrame:
    """Probable phenotype against the other admissions."""
    exposed = F.col("probable_checkpoint_irae_icu") == 1
    return data.withColumns(
        {
            "primary_exposure": exposed.cast("int"),
            "exposure_label": F.when(exposed, "probable").when(~exposed, "other_cancer_icu"),
        }
    )


def denominators_overall(data: DataFrame) -> DataFrame:
    return data.groupBy("site_name").agg(
        F.lit(DENOMINATOR).alias("denominator_name"), F.count(F.lit(1)).alias("n")
    )


def denominators_yearly(data: DataFrame) -> DataFrame:
    return data.groupBy("site_name", "icu_year").agg(
        F.lit(DENOMINATOR).alias("denominator_name"), F.count(F.lit(1)).alias("n")
    )


def _tier_sums() -> list[Column]:
    return [sum_or_zero(F.col(tier)).alias(f"n_{short}") for tier, short in zip(TIERS, SHORT)]


def qc_summary(data: DataFrame) -> DataFrame:
    died = F.col("hospital_mortality")
    return data.groupBy("site_name").agg(
        F.count(F.lit(1)).alias("n_cancer_icu_broad"),
        *_tier_sums(),
        F.avg(died).alias("hospital_mortality_overall"),
        F.avg(F.when(F.col("phenotype_primary") == 1, died)).alias("hospital_mortality_probable"),
    )


def _rates(counts: DataFrame) -> DataFrame:
    """Percent and per-1,000 rate of each tier."""
    out = {}
    for short in SHORT:
        share = ratio(F.col(f"n_{short}"), F.col("n_denominator"))
        out[f"pct_{short}"] = 100 * share
        out[f"rate_{short}_per_1000"] = 1000 * share
    return counts.withColumns(out)


def burden_overall(data: DataFrame) -> DataFrame:
    return _rates(
        data.groupBy("site_name").agg(
            F.lit(DENOMINATOR).alias("denominator"), F.count(F.lit(1)).alias("n_denominator"), *_tier_sums()
        )
    )


def rate_join(denominators: DataFrame, cases: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Cases onto denominators; a denominator without cases gets zeros."""
    return null_safe_join(denominators, cases, keys, "left").fillna(0, subset=counts)


def burden_yearly(data: DataFrame, denominators: DataFrame | None = None) -> DataFrame:
    """Rates per site and ICU year.

    With ``denominators`` (site_name, icu_year, denominator_name, n) cases are
    joined onto them; otherwise both come from one pass over the data.
    """
    keys = ["site_name", "icu_year"]
    if denominators is None:
        counted = data.groupBy(*keys).agg(
            F.lit(DENOMINATOR).alias("denominator_name"), F.count(F.lit(1)).alias("n_denominator"), *_tier_sums()
        )
        return _rates(counted)
    cases = data.groupBy(*keys).agg(*_tier_sums())
    renamed = denominators.withColumnRenamed("n", "n_denominator")
    return _rates(rate_join(renamed, cases, keys, [f"n_{short}" for short in SHORT]))


def module_prevalence(data: DataFrame) -> DataFrame:
    """Organ modules among probable cases."""
    probable = F.col("probable_checkpoint_irae_icu") == 1
    wide = data.agg(
        sum_or_zero(F.col("probable_checkpoint_irae_icu")).alias("denominator"),
        *[F.coalesce(F.sum(F.when(probable, F.col(m))), F.lit(0)).alias(m) for m in ORGAN_MODULES],
    )
    rows = wide.unpivot(["denominator"], ORGAN_MODULES, "module", "n")
    return rows.withColumn("pct", 100 * ratio(F.col("n"), F.col("denominator")))


def tier_counts(data: DataFrame) -> DataFrame:
    return data.groupBy("phenotype_tier").agg(F.count(F.lit(1)).alias("n"))


def outcome_desc_binary(data: DataFrame) -> DataFrame:
    return binary_table(with_exposure(data), BINARY_OUTCOMES, ["exposure_label"], "outcome")


def outcome_desc_continuous(data: DataFrame) -> DataFrame:
    return continuous_table(with_exposure(data), CONTINUOUS_OUTCOMES, ["exposure_label"], "outcome")


def table1_binary(data: DataFrame) -> DataFrame:
    return binary_table(with_exposure(data), TABLE1_BINARY, ["exposure_label"])


def table1_continuous(data: DataFrame) -> DataFrame:
    return continuous_table(with_exposure(data), TABLE1_CONTINUOUS, ["exposure_label"])


def sensitivity_by_tier(data: DataFrame) -> DataFrame:
    flagged = data.filter(F.col("phenotype_tier") != "not_flagged")
    names = ["hospital_mortality", "any_imv", "any_vasopressor", "any_crrt"]
    rates = flagged.groupBy("phenotype_tier").agg(
        F.count(F.lit(1)).alias("n"), *[(100 * F.avg(name)).alias(f"{name}_pct") for name in names]
    )
    stays = {"hospital_los_days": "median_hospital_los", "icu_los_days": "median_icu_los"}
    medians = exact_percentiles(flagged, list(stays), [0.5], ["phenotype_tier"])
    # At most one row per tier and stay.
    wide = medians.groupBy("phenotype_tier").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("p")[0])).alias(name) for v, name in stays.items()]
    )
    return rates.join(wide, "phenotype_tier", "left")


def _decedents(data: DataFrame) -> DataFrame:
    """Deaths with the life expectancy at admission as years lost."""
    return data.filter(F.col("hospital_mortality") == 1).withColumn(
        "yll", remaining_life_expectancy(F.col("age_at_admission"))
    )


def _yll_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_deaths"),
        sum_or_zero(F.col("yll")).alias("total_yll"),
        F.avg("yll").alias("mean_yll_per_death"),
    ]


def yll_overall(data: DataFrame) -> DataFrame:
    deaths = _decedents(data)
    median = scalar_percentiles(deaths, "yll", [0.5])
    return deaths.agg(*_yll_stats()).withColumn("median_yll_per_death", median.scalar()[0])


def _yll_by(deaths: DataFrame, group: str) -> DataFrame:
    median = exact_percentiles(deaths, ["yll"], [0.5], [group]).select(
        group, F.col("p")[0].alias("median_yll_per_death")
    )
    return null_safe_join(deaths.groupBy(group).agg(*_yll_stats()), median, [group], "left")


def yll_by_exposure(data: DataFrame) -> DataFrame:
    label = F.when(F.col("probable_checkpoint_irae_icu") == 1, "probable").otherwise("other_cancer_icu")
    return _yll_by(_decedents(data.withColumn("exposure_label", label)), "exposure_label")


def yll_by_tier(data: DataFrame) -> DataFrame:
    return _yll_by(_decedents(data.filter(F.col("phenotype_tier") != "not_flagged")), "phenotype_tier")


def yll_per_case(data: DataFrame, tier_denominator: str = "inclusive") -> DataFrame:
    """Years lost per exclusive tier over its cases.

    ``inclusive`` counts every admission that meets the tier (a higher tier
    also meets a lower one); ``exclusive`` counts the admissions whose highest
    tier it is.
    """
    yll = remaining_life_expectancy(F.col("age_at_admission"))
    aggs = []
    for tier, short in zip(TIERS, SHORT):
        own = F.col("phenotype_tier") == short
        cases = sum_or_zero(F.col(tier)) if tier_denominator == "inclusive" else count_where(own)
        lost = F.sum(F.when(own & (F.col("hospital_mortality") == 1), yll))
        aggs += [cases.alias(f"cases__{short}"), F.coalesce(lost, F.lit(0.0)).alias(f"yll__{short}")]
    entries = [
        F.struct(
            F.lit(short).alias("group"),
            F.col(f"cases__{short}").alias("n_cases"),
            F.col(f"yll__{short}").alias("total_yll"),
        )
        for short in SHORT
    ]
    rows = data.agg(*aggs).select(F.inline(F.array(*entries)))
    return rows.withColumn("yll_per_case", ratio(F.col("total_yll"), F.col("n_cases")))
