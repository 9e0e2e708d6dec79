"""Cancer ICU cohort, windowed features, organ modules and phenotype tiers.

Feature blocks take raw event tables. Text is cleaned after the anchored join,
so only windowed events of the cohort are cleaned and the shuffle carries the
raw columns once. A missing optional table (``None``) gives the block's
constant columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_string, mentions, parse_dt, to_num, try_num, upper_code
from ..functions.semantics import flag, in_set, known, sum_or_zero
from ..operators.anchors import KEY, SUPPORTIVE_DX, dx_flags, icu_anchor, poa_cancer
from ..operators.windows import Feature, Get, Source, union_features
from ..sources.io import materialize, require_tables

ADULT_AGE = 18

# Device, drug and analyte vocabularies of the phenotype.
HFNC_DEVICES = ["high flow nc", "hfnc"]
NIPPV_DEVICES = ["nippv", "cpap", "bipap"]
VASOPRESSORS = [
    "norepinephrine", "epinephrine", "phenylephrine", "vasopressin",
    "dopamine", "dobutamine", "milrinone", "angiotensin",
]
STEROIDS = ["methylprednisolone", "prednisone", "prednisolone", "dexamethasone", "hydrocortisone"]
RESCUE_DRUGS = [
    "mycophenolate", "infliximab", "tocilizumab", "abatacept", "rituximab", "cyclophosphamide",
    "immune globulin", "ivig",
]
LAB_ANALYTES = {
    "ferritin_max": ("max", "ferritin"),
    "crp_max": ("max", "crp|c reactive|c reactive protein|hs crp"),
    "esr_max": ("max", "esr|sed rate|sedimentation"),
    "troponin_max": ("max", "troponin"),
    "ast_max": ("max", "^ast$|sgot"),
    "alt_max": ("max", "^alt$|sgpt"),
    "bili_max": ("max", "bilirubin"),
    "creat_max": ("max", "creatinine"),
    "lactate_max": ("max", "lactate"),
    "wbc_max": ("max", "wbc|white blood"),
    "eos_max": ("max", "eosin"),
    "plt_min": ("min", "platelet"),
}
VITAL_SIGNS = {
    "temp_max": ("max", "temp_c"),
    "hr_max": ("max", "heart_rate"),
    "map_min": ("min", "map"),
    "spo2_min": ("min", "spo2"),
    "rr_max": ("max", "respiratory_rate"),
}
ORGAN_MODULES = [
    "pulm_irae_like", "cardiac_irae_like", "hepatic_irae_like", "renal_irae_like", "hyperinflammatory_irae_like",
]
TIERS = [
    "possible_checkpoint_irae_icu", "probable_checkpoint_irae_icu", "high_confidence_checkpoint_irae_icu",
]
LAB_FLAGS = [
    "inflam_marker_positive", "hepatitis_lab_positive", "myocarditis_lab_positive", "renal_lab_positive",
    "cytokine_storm_like",
]
VITAL_FLAGS = ["fever_flag", "shock_vitals_flag", "hypoxemia_flag"]
SUPPORT_FLAGS = ["any_imv", "any_hfnc", "any_nippv", "any_vasopressor", "any_crrt"]
TREATMENT_FLAGS = ["any_steroid", "any_rescue_immunosuppression"]


def standardize(
    table: DataFrame,
    times: tuple[str, ...] = (),
    clean: Mapping[str, str] | None = None,
    codes: Mapping[str, str] | None = None,
    numbers: Mapping[str, str] | None = None,
    first_numbers: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parse times and add cleaned, upper-cased and numeric columns (``new name -> source``)."""
    columns: dict[str, Column] = {name: parse_dt(table, name) for name in times}
    columns |= {new: clean_string(F.col(old)) for new, old in (clean or {}).items()}
    columns |= {new: upper_code(F.col(old)) for new, old in (codes or {}).items()}
    columns |= {new: try_num(F.col(old)) for new, old in (numbers or {}).items()}
    columns |= {new: to_num(F.col(old)) for new, old in (first_numbers or {}).items()}
    return table.withColumns(columns)


def standardize_tables(tables: Mapping[str, DataFrame | None]) -> dict[str, DataFrame]:
    """All study tables with parsed times, cleaned text and numeric values."""
    rules = {
        "adt": dict(times=("in_dttm", "out_dttm"), clean={"location_category": "location_category"}),
        "hospitalization": dict(times=("admission_dttm", "discharge_dttm")),
        "hospital_diagnosis": dict(
            codes={"diagnosis_code_clean": "diagnosis_code", "diagnosis_code_format": "diagnosis_code_format"}
        ),
        "labs": dict(
            times=("lab_result_dttm", "lab_collect_dttm"),
            first_numbers={"lab_value_num": "lab_value"},
            clean={"lab_category_clean": "lab_category", "lab_name_clean": "lab_name"},
        ),
        "vitals": dict(
            times=("recorded_dttm",),
            clean={"vital_category_clean": "vital_category"},
            numbers={"vital_value_num": "vital_value"},
        ),
        "respiratory_support": dict(
            times=("recorded_dttm",),
            clean={"device_category_clean": "device_category"},
            numbers={"fio2_set_num": "fio2_set"},
        ),
        "crrt_therapy": dict(times=("recorded_dttm",)),
        "medication_admin_continuous": dict(
            times=("admin_dttm",), clean={"med_name_clean": "med_name", "med_category_clean": "med_category"}
        ),
        "medication_admin_intermittent": dict(
            times=("admin_dttm",),
            clean={
                "med_name_clean": "med_name",
                "med_category_clean": "med_category",
                "mar_action_group_clean": "mar_action_group",
            },
        ),
    }
    return {name: standardize(tables[name], **rule) for name, rule in rules.items() if tables.get(name) is not None}


def adult_filter(df: DataFrame, minimum: float = ADULT_AGE) -> DataFrame:
    return df.filter(F.col("age_at_admission") >= minimum)


def cohort_inner(hospitalization: DataFrame, icu: DataFrame, cancer: DataFrame) -> DataFrame:
    """Adult hospitalizations that have both anchors (one row per hospitalization on each side)."""
    times = standardize(hospitalization, times=("admission_dttm", "discharge_dttm"))
    return adult_filter(times).join(icu, KEY).join(cancer, KEY)


def cancer_icu_broad(hospitalization: DataFrame, adt: DataFrame, diagnoses: DataFrame) -> DataFrame:
    return cohort_inner(hospitalization, icu_anchor(adt), poa_cancer(diagnoses))


def _no_events(anchors: DataFrame, flags: list[str], values: list[str], text: tuple[str, ...] = ()) -> DataFrame:
    """Block of an absent optional table: zero flags, missing values."""
    return anchors.select(
        KEY,
        *[F.lit(0).alias(name) for name in flags],
        *[F.lit(None).cast("double").alias(name) for name in values],
        *[F.lit(None).cast("string").alias(name) for name in text],
    )


def resp_source(respiratory: DataFrame, **window) -> Source:
    return Source(
        respiratory,
        "recorded_dttm",
        ("device_category",),
        lambda raw: {"device": clean_string(raw("device_category"))},
        lambda text: [
            Feature("any_imv", "any", text("device") == "imv"),
            Feature("any_hfnc", "any", text("device").isin(*HFNC_DEVICES)),
            Feature("any_nippv", "any", text("device").isin(*NIPPV_DEVICES)),
            Feature("max_fio2", "max", F.lit(True)),
        ],
        number="fio2_set",
        parse=try_num,
        **window,
    )


def resp_features(respiratory: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if respiratory is None:
        return _no_events(anchors, SUPPORT_FLAGS[:3], ["max_fio2"])
    return _features(resp_source, respiratory, anchors, window)


def _features(source: Callable[..., Source], table: DataFrame, anchors: DataFrame, options: Mapping) -> DataFrame:
    """Features of one table; ``options`` are bounds of the window and what ``union_features`` takes."""
    bounds = {k: v for k, v in options.items() if k in ("before_hours", "after_hours")}
    return union_features([source(table, **bounds)], anchors, **{k: v for k, v in options.items() if k not in bounds})


def _medication_texts(raw: Get) -> dict[str, Column]:
    return {"name": clean_string(raw("med_name")), "category": clean_string(raw("med_category"))}


def _drug(text: Get, drugs: list[str]) -> Column:
    """Drug named in the medication text, or the category itself."""
    return mentions(text("name"), "|".join(drugs)) | in_set(text("category"), drugs)


def vasopressor_source(continuous: DataFrame, **window) -> Source:
    return Source(
        continuous,
        "admin_dttm",
        ("med_name", "med_category"),
        _medication_texts,
        lambda text: [Feature("any_vasopressor", "any", _drug(text, VASOPRESSORS))],
        **window,
    )


def vasopressor_features(continuous: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if continuous is None:
        return _no_events(anchors, ["any_vasopressor"], [])
    return _features(vasopressor_source, continuous, anchors, window)


def crrt_source(crrt: DataFrame, **window) -> Source:
    """Any event in the window counts."""
    return Source(crrt, "recorded_dttm", (), lambda raw: {}, lambda text: [Feature("any_crrt", "any", F.lit(True))], **window)


def crrt_features(crrt: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if crrt is None:
        return _no_events(anchors, ["any_crrt"], [])
    return _features(crrt_source, crrt, anchors, window)


def administered(action: Column) -> Column:
    """Given, or the action was not recorded."""
    cleaned = clean_string(action)
    return cleaned.isNull() | (cleaned == "administered")


def steroid_rescue_source(intermittent: DataFrame, **window) -> Source:
    def features(text: Get) -> list[Feature]:
        steroid = _drug(text, STEROIDS)
        return [
            Feature("any_steroid", "any", steroid),
            Feature("any_rescue_immunosuppression", "any", mentions(text("name"), "|".join(RESCUE_DRUGS))),
            Feature("steroid_names", "names", F.when(steroid, text("name"))),
        ]

    return Source(
        intermittent,
        "admin_dttm",
        ("med_name", "med_category", "mar_action_group"),
        lambda raw: {**_medication_texts(raw), "action": raw("mar_action_group")},
        features,
        keep=lambda text: administered(text("action")),
        **window,
    )


def steroid_rescue_features(intermittent: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if intermittent is None:
        return _no_events(anchors, TREATMENT_FLAGS, [], ("steroid_names",))
    return _features(steroid_rescue_source, intermittent, anchors, window)


def lab_source(labs: DataFrame, **window) -> Source:
    """Extreme value per analyte; the analyte is recognised in the category or the name."""
    return Source(
        labs,
        "lab_result_dttm",
        ("lab_category", "lab_name"),
        lambda raw: {"category": clean_string(raw("lab_category")), "name": clean_string(raw("lab_name"))},
        lambda text: [
            Feature(column, kind, mentions(text("category"), pattern) | mentions(text("name"), pattern))
            for column, (kind, pattern) in LAB_ANALYTES.items()
        ],
        number="lab_value",
        parse=to_num,
        **window,
    )


def lab_features(labs: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if labs is None:
        return _no_events(anchors, [], list(LAB_ANALYTES))
    return _features(lab_source, labs, anchors, window)


def lab_flags(df: DataFrame) -> DataFrame:
    def at_least(name: str, bound: float) -> Column:
        return F.col(name) >= bound

    storm = at_least("ferritin_max", 3000) | (
        at_least("ferritin_max", 1000) & at_least("crp_max", 10) & (F.col("plt_min") < 100)
    )
    inflamed = at_least("ferritin_max", 1000) | at_least("crp_max", 10) | at_least("esr_max", 50)
    hepatic = at_least("ast_max", 200) | at_least("alt_max", 200) | at_least("bili_max", 2)
    return df.withColumns(
        {
            "inflam_marker_positive": flag(inflamed),
            "hepatitis_lab_positive": flag(hepatic),
            "myocarditis_lab_positive": flag(F.col("troponin_max") > 0),
            "renal_lab_positive": flag(at_least("creat_max", 2)),
            "cytokine_storm_like": flag(storm),
        }
    )


def vital_source(vitals: DataFrame, after_hours: int = 24, **window) -> Source:
    """Extremes of the raw vital categories, by default in the day before and after the anchor."""
    return Source(
        vitals,
        "recorded_dttm",
        ("vital_category",),
        lambda raw: {"sign": raw("vital_category")},
        lambda text: [Feature(column, kind, text("sign") == sign) for column, (kind, sign) in VITAL_SIGNS.items()],
        number="vital_value",
        parse=try_num,
        after_hours=after_hours,
        **window,
    )


def vital_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fever_flag": flag(F.col("temp_max") >= 38.0),
            "shock_vitals_flag": flag(F.col("map_min") < 65),
            "hypoxemia_flag": flag(F.col("spo2_min") < 90),
        }
    )


def vital_features(vitals: DataFrame | None, anchors: DataFrame, **window) -> DataFrame:
    if vitals is None:
        return vital_flags(_no_events(anchors, [], list(VITAL_SIGNS)))
    return vital_flags(_features(vital_source, vitals, anchors, window))


def irae_counts(df: DataFrame) -> DataFrame:
    """Zero-fill the flags and count diagnoses, support and immune signals."""
    flags = [*SUPPORTIVE_DX, *SUPPORT_FLAGS, *TREATMENT_FLAGS, *LAB_FLAGS, *VITAL_FLAGS]
    filled = df.fillna(0, subset=flags)

    def total(names) -> Column:
        return sum((F.col(name) for name in names), F.lit(0))

    return filled.withColumns(
        {
            "organ_dx_count": total(SUPPORTIVE_DX),
            "severe_support_count": total(["any_imv", "any_vasopressor", "any_crrt"])
            + flag((F.col("any_hfnc") == 1) & (F.col("hypoxemia_flag") == 1)),
            "immune_signal_count": total([*LAB_FLAGS, "fever_flag"]),
        }
    )


def irae_modules(df: DataFrame, fio2_cut: float = 60) -> DataFrame:
    """Five organ modules; each needs steroids. ``fio2_cut`` is on the percent scale."""

    def on(name: str) -> Column:
        return F.col(name) == 1

    steroid = on("any_steroid")
    breathing = (
        on("any_imv") | on("any_hfnc") | on("any_nippv")
        | known(F.col("spo2_min") < 90) | known(F.col("max_fio2") >= fio2_cut)
    )
    heart = known(F.col("troponin_max") > 0) & (on("any_vasopressor") | known(F.col("lactate_max") >= 2))
    kidney = known(F.col("creat_max") >= 2) | on("any_crrt")
    inflamed = (on("inflam_marker_positive") | on("cytokine_storm_like")) & (
        on("fever_flag") | on("any_vasopressor") | on("any_imv")
    )
    out = df.withColumns(
        {
            "pulm_irae_like": flag(breathing & steroid),
            "cardiac_irae_like": flag(heart & steroid),
            "hepatic_irae_like": flag(on("hepatitis_lab_positive") & steroid),
            "renal_irae_like": flag(kidney & steroid),
            "hyperinflammatory_irae_like": flag(inflamed & steroid),
        }
    )
    return out.withColumn("n_irae_modules", sum((F.col(m) for m in ORGAN_MODULES), F.lit(0)))


def irae_tiers(df: DataFrame) -> DataFrame:
    """Possible, probable and high-confidence flags (high through rescue needs no module)."""

    def on(name: str) -> Column:
        return F.col(name) == 1

    modules, steroid = F.col("n_irae_modules"), on("any_steroid")
    major = on("any_imv") | on("any_vasopressor") | on("any_crrt")
    possible = (modules >= 1) | (
        (F.col("organ_dx_count") >= 1) & steroid & (F.col("severe_support_count") >= 1)
    )
    probable = ((modules >= 1) & major) | (
        on("cytokine_storm_like") & steroid & (on("any_imv") | on("any_vasopressor"))
    )
    high = ((modules >= 2) & major) | (on("any_rescue_immunosuppression") & major)
    return df.withColumns(dict(zip(TIERS, [flag(possible), flag(probable), flag(high)])))


def feature_assembly(cohort: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """Left-join one-row-per-hospitalization blocks onto the cohort."""
    out = cohort
    for block in blocks:
        out = out.join(block, KEY, "left")
    return out.drop("hospitalization_joined_id")


def irae_features(
    tables: Mapping[str, DataFrame | None],
    store: Callable[[DataFrame], DataFrame] = materialize,
    fio2_cut: float = 60,
) -> DataFrame:
    """One row per cohort hospitalization: features, counts, modules and tiers.

    ``store`` writes the cohort once, so that joins see its true size. The event tables meet it in one union.
    """
    require_tables(tables)
    cohort = store(cancer_icu_broad(tables["hospitalization"], tables["adt"], tables["hospital_diagnosis"]))
    anchors = cohort.select(KEY, "first_icu_in")
    makers = {
        "respiratory_support": (resp_source, resp_features),
        "medication_admin_continuous": (vasopressor_source, vasopressor_features),
        "crrt_therapy": (crrt_source, crrt_features),
        "medication_admin_intermittent": (steroid_rescue_source, steroid_rescue_features),
        "labs": (lab_source, lab_features),
        "vitals": (vital_source, lambda table, own: _no_events(own, [], list(VITAL_SIGNS))),
    }
    present = [source(tables[name]) for name, (source, _) in makers.items() if tables.get(name) is not None]
    # constant columns of absent tables need no join
    absent = {}
    for name, (_, block) in makers.items():
        if tables.get(name) is None:
            absent |= {f.name: F.lit(None).cast(f.dataType) for f in block(None, anchors).schema.fields if f.name != KEY}
    blocks = [dx_flags(tables["hospital_diagnosis"].join(anchors.select(KEY), KEY, "left_semi"))]
    if present:
        blocks.append(union_features(present, anchors))
    features = vital_flags(lab_flags(feature_assembly(cohort, blocks).withColumns(absent)))
    return irae_tiers(irae_modules(irae_counts(features), fio2_cut))


def checkpoint_suspected(features: DataFrame) -> DataFrame:
    return features.filter(F.col("possible_checkpoint_irae_icu") == 1)


def phenotype_summary_counts(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_cancer_icu_broad"),
        *[sum_or_zero(F.col(name)).alias(f"n_{name}") for name in [*TIERS, *ORGAN_MODULES]],
    )
