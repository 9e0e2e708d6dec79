"""Per-hospitalization anchors and diagnosis flags.

Every aggregate here is combined map-side before the shuffle, so one very long
hospitalization costs one partial row per input task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_string, parse_dt, upper_code
from ..functions.semantics import any_flag, known, matches, sorted_names

KEY = "hospitalization_id"

# Cancer code prefixes by code system.
CANCER_ICD10 = [
    "^C0", "^C1", "^C2", "^C3", "^C4", "^C5", "^C6", "^C7", "^C8", "^C9",
    "^C[1-7][0-9]",
    "^C80", "^C81", "^C82", "^C83", "^C84", "^C85", "^C86", "^C88",
    "^C90", "^C91", "^C92", "^C93", "^C94", "^C95", "^C96", "^C7A", "^C7B",
    "^V10", "^Z85",
]
CANCER_ICD9 = [
    "^14[0-9]", "^15[0-9]", "^16[0-9]", "^17[0-9]", "^18[0-9]", "^19[0-9]",
    "^20[0-9]", "^21[0-9]", "^22[0-9]", "^23[0-9]",
    "^V10",
]
CANCER_CODES = {"ICD10CM": CANCER_ICD10, "ICD9CM": CANCER_ICD9}

# Supportive diagnosis groups (all diagnoses, either code system).
SUPPORTIVE_DX = {
    "dx_pneumonitis": "^J70|^J84|^J96|^J98",
    "dx_myocarditis": r"^I40|^I41|^I51\.4|^I30|^I31",
    "dx_hepatitis": "^K71|^K72|^K75|^R74",
    "dx_colitis": r"^K52|^K51|^A09|^R19\.7",
    "dx_nephritis": "^N10|^N12|^N14|^N17|^N05",
    "dx_endocrine": "^E03|^E05|^E10|^E11|^E16|^E23|^E27",
    "dx_neuro": "^G04|^G70|^G72|^G61|^G62|^R56|^G93",
    "dx_hlh_like": "^D76",
}


def icu_anchor(adt: DataFrame, location: str = "icu", key: str = KEY) -> DataFrame:
    """First entry, last exit and segment count per hospitalization at a location."""
    return (
        adt.filter(clean_string(F.col("location_category")) == location)
        .select(key, parse_dt(adt, "in_dttm").alias("in_dttm"), parse_dt(adt, "out_dttm").alias("out_dttm"))
        .groupBy(key)
        .agg(
            F.min("in_dttm").alias("first_icu_in"),
            F.max("out_dttm").alias("last_icu_out"),
            F.count(F.lit(1)).alias("n_icu_segments"),
        )
    )


def code_prefix_match(code, code_format, prefixes_by_format: dict[str, list[str]]):
    """Code starts with a listed prefix of its own code system."""
    out = F.lit(False)
    for name, prefixes in prefixes_by_format.items():
        out = out | ((code_format == name) & matches(code, prefixes))
    return out


def poa_cancer(diagnoses: DataFrame, codes: dict[str, list[str]] = CANCER_CODES, key: str = KEY) -> DataFrame:
    """Hospitalizations with a matching diagnosis present on admission, and the matching codes."""
    code = upper_code(F.col("diagnosis_code"))
    system = upper_code(F.col("diagnosis_code_format"))
    return (
        diagnoses.filter((F.col("poa_present") == 1) & code_prefix_match(code, system, codes))
        .groupBy(key)
        .agg(F.lit(1).alias("poa_cancer"), sorted_names(code).alias("cancer_codes_poa"))
    )


def dx_flags(diagnoses: DataFrame, groups: dict[str, str] = SUPPORTIVE_DX, key: str = KEY) -> DataFrame:
    """One any-match flag per diagnosis group."""
    code = upper_code(F.col("diagnosis_code"))
    return diagnoses.groupBy(key).agg(
        *[any_flag(code.rlike(pattern)).alias(name) for name, pattern in groups.items()]
    )


def location_hours(adt: DataFrame, location: str = "icu", key: str = KEY) -> DataFrame:
    """Summed hours of the segments at a location; open or reversed segments count zero."""
    start, end = parse_dt(adt, "in_dttm"), parse_dt(adt, "out_dttm")
    hours = F.timestamp_diff("MICROSECOND", start, end) / F.lit(3600e6)
    return (
        adt.filter(clean_string(F.col("location_category")) == location)
        .groupBy(key)
        .agg(F.coalesce(F.sum(F.when(hours > 0, hours)), F.lit(0.0)).alias("location_hours"))
    )


def icu_min_stay(adt: DataFrame, hours: float = 24.0, location: str = "icu", key: str = KEY) -> DataFrame:
    """Hospitalizations with at least ``hours`` at a location."""
    return location_hours(adt, location, key).filter(F.col("location_hours") >= hours)


def ids_ever(df: DataFrame, cond, key: str = KEY) -> DataFrame:
    """Distinct ids with at least one matching row."""
    return df.filter(known(cond)).select(key).distinct()


def ever_device(
    cohort: DataFrame, respiratory: DataFrame, include: str = "imv", exclude: str | None = None, key: str = KEY
) -> DataFrame:
    """Keep ids once on one device, leave out ids ever on another."""
    device = clean_string(F.col("device_category"))
    kept = cohort.join(ids_ever(respiratory, device == include, key), key, "left_semi")
    if exclude is not None:
        kept = kept.join(ids_ever(respiratory, device == exclude, key), key, "left_anti")
    return kept
