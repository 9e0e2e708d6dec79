"""Analysis table: calendar, age band, tiers, discharge outcomes, length of stay, cancer type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    DISCHARGE_KEYWORDS,
    age_band,
    cancer_type_broad,
    clean_string,
    days_between,
    discharge_flag,
    phenotype_tier,
)
from ..functions.semantics import flag

# Columns of the analysis table, in order.
ANALYSIS_COLUMNS = [
    "site_name", "patient_id", "hospitalization_id",
    "admission_dttm", "discharge_dttm", "first_icu_in", "last_icu_out",
    "admit_year", "icu_year", "icu_month", "icu_year_month", "age_at_admission", "age_band",
    "admission_type_name", "admission_type_category", "discharge_name", "discharge_category",
    "discharge_name_clean", "discharge_category_clean",
    "zipcode_five_digit", "zipcode_nine_digit", "census_tract", "county_code", "state_code",
    "poa_cancer", "cancer_codes_poa", "cancer_type_broad",
    "phenotype_tier", "phenotype_any", "phenotype_primary", "phenotype_high",
    "possible_checkpoint_irae_icu", "probable_checkpoint_irae_icu", "high_confidence_checkpoint_irae_icu",
    "pulm_irae_like", "cardiac_irae_like", "hepatic_irae_like", "renal_irae_like", "hyperinflammatory_irae_like",
    "n_irae_modules",
    "dx_pneumonitis", "dx_myocarditis", "dx_hepatitis", "dx_colitis", "dx_nephritis", "dx_endocrine", "dx_neuro",
    "dx_hlh_like", "organ_dx_count", "severe_support_count", "immune_signal_count",
    "any_imv", "any_hfnc", "any_nippv", "max_fio2", "any_vasopressor", "any_crrt",
    "any_steroid", "any_rescue_immunosuppression", "steroid_names",
    "ferritin_max", "crp_max", "esr_max", "troponin_max", "ast_max", "alt_max", "bili_max", "creat_max",
    "lactate_max", "wbc_max", "eos_max", "plt_min",
    "temp_max", "hr_max", "map_min", "spo2_min", "rr_max",
    "inflam_marker_positive", "hepatitis_lab_positive", "myocarditis_lab_positive", "renal_lab_positive",
    "cytokine_storm_like", "fever_flag", "shock_vitals_flag", "hypoxemia_flag",
    "hospital_mortality", "hospice_discharge", "home_discharge", "facility_discharge",
    "hospital_los_days", "icu_los_days", "prolonged_hospital_los", "prolonged_icu_los", "any_major_support",
]


def icu_calendar(entry: Column) -> dict[str, Column]:
    return {
        "icu_year": F.year(entry),
        "icu_month": F.month(entry),
        "icu_year_month": F.date_format(entry, "yyyy-MM"),
    }


def length_of_stay() -> dict[str, Column]:
    hospital = days_between(F.col("admission_dttm"), F.col("discharge_dttm"))
    icu = days_between(F.col("first_icu_in"), F.col("last_icu_out"))
    return {
        "hospital_los_days": hospital,
        "icu_los_days": icu,
        "prolonged_hospital_los": flag(hospital >= 14),
        "prolonged_icu_los": flag(icu >= 7),
    }


def discharge_flags() -> dict[str, Column]:
    name, category = clean_string(F.col("discharge_name")), clean_string(F.col("discharge_category"))
    return {
        "discharge_name_clean": name,
        "discharge_category_clean": category,
        **{flag_name: discharge_flag(name, category, words) for flag_name, words in DISCHARGE_KEYWORDS.items()},
    }


def any_major_support() -> Column:
    return flag((F.col("any_imv") == 1) | (F.col("any_vasopressor") == 1) | (F.col("any_crrt") == 1))


def analysis_dataset(features: DataFrame, site_name: str = "SITE") -> DataFrame:
    high, probable, possible = (
        F.col("high_confidence_checkpoint_irae_icu"),
        F.col("probable_checkpoint_irae_icu"),
        F.col("possible_checkpoint_irae_icu"),
    )
    return features.withColumns(
        {
            "site_name": F.lit(site_name),
            "admit_year": F.year("admission_dttm"),
            **icu_calendar(F.col("first_icu_in")),
            "age_band": age_band(F.col("age_at_admission")),
            "phenotype_tier": phenotype_tier(high, probable, possible),
            "phenotype_primary": flag(probable == 1),
            "phenotype_any": (possible == 1).cast("int"),
            "phenotype_high": (high == 1).cast("int"),
            **discharge_flags(),
            **length_of_stay(),
            "any_major_support": any_major_support(),
            "cancer_type_broad": cancer_type_broad(F.col("cancer_codes_poa")),
        }
    ).select(*ANALYSIS_COLUMNS)
