"""County-year exposure linkage, quartiles, and pollution-attributable years of life lost."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pad_fips, rate_with_ci, remaining_life_expectancy
from ..functions.semantics import clip_low, count_where, ratio, sum_or_zero
from ..operators.models import fit_logistic, tidy
from ..operators.quantiles import add_ntiles, scalar_percentiles
from ..sources.io import materialize
from ..sources.lookups import require_unique

MAX_YEAR = 2024
PANEL_KEYS = ["county_code", "icu_year"]

# Panel columns, quartile labels, components and series names.
PM25_COLUMNS = {"pm25_annual": ("pm25_mean", "double"), "pm25_filled_2024": ("pm25_filled_2024", "boolean")}
NO2_COLUMNS = {"no2_annual": ("no2_mean", "double")}
SVI_COLUMNS = {
    "svi_year_release": ("year_release", "int"),
    **{name: (name, "double") for name in ["svi_overall", "svi_theme1", "svi_theme2", "svi_theme3", "svi_theme4"]},
}
QUARTILES = {"pm25_q": "pm25_annual", "no2_q": "no2_annual", "svi_q": "svi_overall"}
QUARTILE_LABELS = ["Q1 lowest", "Q2", "Q3", "Q4 highest"]
Q1 = QUARTILE_LABELS[0]
COMPONENTS = {
    "Baseline YLL at Q1 rate": "baseline_total_yll_q1_rate",
    "Excess YLL above Q1": "excess_total_yll_vs_q1",
}
MODEL_LABELS = {
    ("probable_checkpoint_irae_icu", "pm25_annual"): "ICI irAE burden per 1-unit PM2.5",
    ("probable_checkpoint_irae_icu", "no2_annual"): "ICI irAE burden per 1-unit NO2",
    ("hospital_mortality", "pm25_annual"): "Hospital mortality per 1-unit PM2.5",
    ("any_major_support", "no2_annual"): "Major organ support per 1-unit NO2",
}
MIN_MODEL_ROWS = 50
MIN_MODEL_DEATHS = 10


def up_to_year(df: DataFrame, year: str, max_year: int) -> DataFrame:
    return df.filter(F.col(year).isNotNull() & (F.col(year) <= max_year))


def exposure_lookup(
    panel: DataFrame, columns: Mapping[str, tuple[str, str]], max_year: int = MAX_YEAR
) -> DataFrame:
    """County-year panel with padded county codes and the named, typed columns."""
    typed = panel.select(
        pad_fips(F.col("GEOID")).alias("county_code"),
        F.col("year").cast("int").alias("icu_year"),
        *[F.col(source).try_cast(dtype).alias(name) for name, (source, dtype) in columns.items()],
    )
    return typed.filter(F.col("icu_year") <= max_year)


def exposome_link(
    data: DataFrame,
    pm25: DataFrame,
    no2: DataFrame,
    svi: DataFrame,
    max_year: int = MAX_YEAR,
    strict: bool = True,
) -> DataFrame:
    """Admissions with their county-year exposures; ``strict`` rejects repeated panel keys.

    The panels are bounded by counties and years; the planner broadcasts them
    if they measure small enough and otherwise joins by key.
    """
    out = up_to_year(
        data.withColumns(
            {
                "county_code": pad_fips(F.col("county_code")),
                "icu_year": F.col("icu_year").cast("int"),
                "icu_month": F.col("icu_month").cast("int"),
            }
        ),
        "icu_year",
        max_year,
    )
    for panel, columns in [(pm25, PM25_COLUMNS), (no2, NO2_COLUMNS), (svi, SVI_COLUMNS)]:
        lookup = exposure_lookup(panel, columns, max_year)
        if strict:
            require_unique(lookup, PANEL_KEYS)
        out = out.join(lookup, PANEL_KEYS, "left")
    return out


def exposure_quartiles(linked: DataFrame, tiebreak: str = "hospitalization_id") -> DataFrame:
    """Labelled exposure quartiles over the linked rows; ties are split by the id."""
    tiled = add_ntiles(linked, QUARTILES, tiebreak)
    labels = F.array(*[F.lit(label) for label in QUARTILE_LABELS])
    return tiled.withColumns({name: F.get(labels, F.col(name) - 1) for name in QUARTILES})


def linked_with_quartiles(
    data: DataFrame,
    pm25: DataFrame,
    no2: DataFrame,
    svi: DataFrame,
    max_year: int = MAX_YEAR,
    strict: bool = True,
    store: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Linkage and quartiles; the linked table is stored because the quartiles read it repeatedly."""
    return exposure_quartiles(store(exposome_link(data, pm25, no2, svi, max_year, strict)))


def linkage_qc(linked: DataFrame) -> DataFrame:
    county = F.col("county_code")
    return linked.agg(
        F.count(F.lit(1)).alias("n_total"),
        count_where(county.isNull() | (county == "")).alias("n_county_missing"),
        F.count("pm25_annual").alias("n_pm25_linked"),
        F.count("no2_annual").alias("n_no2_linked"),
        F.count("svi_overall").alias("n_svi_linked"),
        count_where(F.col("pm25_filled_2024")).alias("n_pm25_filled_2024"),
    )


def yearly_exposure_summary(linked: DataFrame) -> DataFrame:
    means = {
        "phenotype_rate": "phenotype_primary",
        "mortality_rate": "hospital_mortality",
        "pm25_mean": "pm25_annual",
        "no2_mean": "no2_annual",
        "svi_mean": "svi_overall",
        "svi_theme3_mean": "svi_theme3",
    }
    return linked.groupBy("icu_year").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(source).alias(name) for name, source in means.items()]
    )


def pollution_models(linked: DataFrame, ci: str = "profile") -> DataFrame:
    """Exposure odds ratios of four adjusted models; a model below 50 complete cases gives no row."""
    specs = [
        ("phenotype_primary", "probable_checkpoint_irae_icu", "pm25_annual", []),
        ("phenotype_primary", "probable_checkpoint_irae_icu", "no2_annual", []),
        ("hospital_mortality", "hospital_mortality", "pm25_annual", ["phenotype_primary"]),
        ("any_major_support", "any_major_support", "no2_annual", ["phenotype_primary"]),
    ]
    fits = []
    for column, outcome, exposure, extra in specs:
        numeric = [exposure, "age_at_admission", *extra, "svi_overall"]
        fit = fit_logistic(
            linked, column, numeric, ["admit_year"], ci=ci, profile_terms=[exposure], min_rows=MIN_MODEL_ROWS
        )
        fits.append((fit, outcome, exposure))
    rows = tidy(linked.sparkSession, fits, [True] * len(fits))
    return rows.filter(F.col("term").isin("pm25_annual", "no2_annual"))


def forest_table(models: DataFrame) -> DataFrame:
    label = F.concat_ws(" ", "outcome", "exposure")
    for (outcome, exposure), text in MODEL_LABELS.items():
        label = F.when((F.col("outcome") == outcome) & (F.col("exposure") == exposure), text).otherwise(label)
    return models.withColumn("label", label)


def probable_yll(linked: DataFrame) -> DataFrame:
    """Probable cases with the years a death would lose."""
    life = remaining_life_expectancy(F.col("age_at_admission"))
    return linked.filter(F.col("phenotype_primary") == 1).withColumns(
        {"remaining_life_exp": life, "yll_if_death": life}
    )


def pm25_reference(probable: DataFrame) -> DataFrame:
    """One row ``ref``: median exposure of the lowest quartile, or the overall lower quartile."""
    lowest = scalar_percentiles(probable.filter(F.col("pm25_q") == Q1), "pm25_annual", [0.5])
    overall = scalar_percentiles(probable, "pm25_annual", [0.25])
    return lowest.select(F.coalesce(F.col("p")[0], overall.scalar()[0]).alias("ref"))


def _observed_yll() -> Column:
    return sum_or_zero(
        F.when(F.col("hospital_mortality") == 1, F.col("yll_if_death")).when(
            F.col("hospital_mortality").isNotNull(), F.lit(0.0)
        )
    )


def pm25_yll_quartiles(probable: DataFrame) -> DataFrame:
    per_q = (
        probable.filter(F.col("pm25_q").isNotNull())
        .groupBy("pm25_q")
        .agg(
            F.count(F.lit(1)).alias("n_probable_cases"),
            sum_or_zero(F.col("hospital_mortality")).alias("n_deaths"),
            _observed_yll().alias("total_yll_observed"),
        )
    )
    per_case = ratio(F.col("total_yll_observed"), F.col("n_probable_cases"))
    baseline = per_q.agg(F.max(F.when(F.col("pm25_q") == Q1, per_case)).alias("baseline")).scalar()
    n, base, excess = F.col("n_probable_cases"), F.col("baseline_yll_per_case_q1"), F.col("excess_total_yll_vs_q1")
    return (
        per_q.withColumn("mean_yll_per_case", per_case)
        .withColumn("mean_yll_per_death", ratio(F.col("total_yll_observed"), F.col("n_deaths")))
        .withColumn("baseline_yll_per_case_q1", baseline)
        .withColumn("baseline_total_yll_q1_rate", base * n)
        .withColumn("excess_yll_per_case_vs_q1", F.col("mean_yll_per_case") - base)
        .withColumn("excess_total_yll_vs_q1", clip_low(F.col("excess_yll_per_case_vs_q1") * n, 0.0))
        .withColumn("observed_minus_excess", clip_low(F.col("total_yll_observed") - excess, 0.0))
    )


def pm25_yll_decomposition(quartiles: DataFrame) -> DataFrame:
    named = quartiles.select("pm25_q", *[F.col(source).alias(name) for name, source in COMPONENTS.items()])
    return named.unpivot(["pm25_q"], [f"`{name}`" for name in COMPONENTS], "component", "yll")


def attributable_yll_patient(probable: DataFrame) -> DataFrame | None:
    """Modelled death risk at the observed and the reference exposure, and the years the excess loses.

    None below 50 complete cases or 10 deaths.
    """
    numeric = ["pm25_annual", "age_at_admission", "svi_overall"]
    used = ["hospital_mortality", *numeric, "admit_year", "yll_if_death"]
    cases = probable.select("hospitalization_id", "icu_year", "pm25_q", *used).dropna(subset=used)
    fit = fit_logistic(
        cases, "hospital_mortality", numeric, ["admit_year"],
        min_rows=MIN_MODEL_ROWS, min_events=MIN_MODEL_DEATHS,
    )
    if fit is None:
        return None
    with_ref = cases.withColumn("pm25_reference", pm25_reference(probable).scalar())
    observed, reference = fit.probability(), fit.probability({"pm25_annual": F.col("pm25_reference")})
    excess = F.col("attributable_excess_death_prob")
    return (
        with_ref.withColumn("predicted_mortality_observed", observed)
        .withColumn("predicted_mortality_reference", reference)
        .withColumn(
            "attributable_excess_death_prob",
            clip_low(F.col("predicted_mortality_observed") - F.col("predicted_mortality_reference"), 0.0),
        )
        .withColumn("attributable_excess_yll", excess * F.col("yll_if_death"))
    )


def attributable_yll_yearly(patients: DataFrame) -> DataFrame:
    value = F.col("attributable_excess_yll")
    return patients.groupBy("icu_year").agg(
        sum_or_zero(value).alias("attributable_excess_yll"), F.avg(value).alias("attributable_excess_yll_per_case")
    )


def attributable_yll_summary(patients: DataFrame) -> DataFrame:
    value = F.col("attributable_excess_yll")
    median = scalar_percentiles(patients, "attributable_excess_yll", [0.5])
    return patients.agg(
        F.max("pm25_reference").alias("pm25_reference"),
        F.count(F.lit(1)).alias("n_probable_cases_modeled"),
        sum_or_zero(value).alias("total_attributable_excess_yll"),
        F.avg(value).alias("mean_attributable_excess_yll_per_case"),
    ).withColumn("median_attributable_excess_yll_per_case", median.scalar()[0])


def pm25_baseline_yll_yearly(probable: DataFrame, quartiles: DataFrame) -> DataFrame:
    base = quartiles.agg(F.max("baseline_yll_per_case_q1").alias("base"))
    return (
        probable.filter(F.col("pm25_annual").isNotNull())
        .groupBy("icu_year")
        .agg(F.count(F.lit(1)).alias("n_probable_cases"), _observed_yll().alias("observed_yll"))
        .withColumn("baseline_yll", F.col("n_probable_cases") * base.scalar())
    )


def pm25_yll_yearly(baseline: DataFrame, attributable: DataFrame | None) -> DataFrame:
    """Baseline plus attributable years; zero attributable where there is no model."""
    names = ["attributable_excess_yll", "attributable_excess_yll_per_case"]
    if attributable is None:
        out = baseline.withColumns({name: F.lit(0.0) for name in names})
    else:
        out = baseline.join(attributable, "icu_year", "left").fillna(0.0, subset=names)
    return out.withColumn("total_yll_with_excess", F.col("baseline_yll") + F.col(names[0]))


def yearly_burden(linked: DataFrame) -> DataFrame:
    counts = linked.groupBy("icu_year").agg(
        F.count(F.lit(1)).alias("n"),
        sum_or_zero(F.col("phenotype_primary")).alias("cases"),
        F.avg("pm25_annual").alias("pm25_mean"),
    )
    return counts.withColumns(rate_with_ci(F.col("cases"), F.col("n")))


def trend_lines(yearly: DataFrame) -> DataFrame:
    """Case rate and admissions, the latter scaled to the former's maximum."""
    top_rate = yearly.agg(F.max("rate").alias("top")).scalar()
    top_n = yearly.agg(F.max("n").alias("top")).scalar()
    scale = F.when(top_rate > 0, top_n / top_rate).otherwise(F.lit(1.0))
    scaled = yearly.select("icu_year", "rate", (F.col("n") / scale).alias("volume"))
    return scaled.select(
        "icu_year",
        F.inline(
            F.array(
                F.struct(F.lit("ICI irAE burden").alias("series"), F.col("rate").alias("value")),
                F.struct(F.lit("Cancer ICU volume").alias("series"), F.col("volume").alias("value")),
            )
        ),
    )


def _quartile_rates(df: DataFrame, event: str) -> DataFrame:
    """Rate and limits per pollutant and quartile; both pollutants in one pass."""
    both = F.array(
        F.struct(F.lit("PM2.5").alias("pollutant"), F.col("pm25_q").alias("exposure_group")),
        F.struct(F.lit("NO2").alias("pollutant"), F.col("no2_q").alias("exposure_group")),
    )
    counts = (
        df.select(event, F.inline(both))
        .filter(F.col("exposure_group").isNotNull())
        .groupBy("exposure_group", "pollutant")
        .agg(F.count(F.lit(1)).alias("n"), sum_or_zero(F.col(event)).alias("events"))
    )
    return counts.withColumns(rate_with_ci(F.col("events"), F.col("n")))


def quartile_phenotype(linked: DataFrame) -> DataFrame:
    return _quartile_rates(linked, "phenotype_primary")


def quartile_mortality(linked: DataFrame) -> DataFrame:
    return _quartile_rates(linked.filter(F.col("phenotype_primary") == 1), "hospital_mortality")
