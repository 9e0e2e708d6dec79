"""Small lookup tables: outlier limits and the note concept dictionary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_csv_required

# Plausible limits per laboratory category.
LAB_LIMITS = [
    ("albumin", 0, 15),
    ("alkaline_phosphatase", 0, 5000),
    ("alt", 0, 20000),
    ("ast", 0, 20000),
    ("basophil_percent", 0, 100),
    ("basophil_absolute", 0, 500),
    ("bicarbonate_arterial", 0, 50),
    ("bicarbonate_venous", 0, 50),
    ("bilirubin_conjugated", 0, 50),
    ("bilirubin_total", 0, 80),
    ("bilirubin_unconjugated", 0, 50),
    ("bun", 0, 250),
    ("calcium_total", 0, 20),
    ("calcium_ionized", 0, 20),
    ("carbon_dioxide", 0, 60),
    ("chloride", 50, 140),
    ("creatinine", 0, 20),
    ("crp", 0, 1000),
    ("eosinophils_percent", 0, 100),
    ("eosinophils_absolute", 0, 500),
    ("esr", 0, 250),
    ("ferritin", 0, 300000),
    ("glucose_fingerstick", 0, 2000),
    ("glucose_serum", 0, 2000),
    ("hemoglobin", 2, 25),
    ("phosphate", 0, 15),
    ("inr", 0, 15),
    ("lactate", 0, 100),
    ("ldh", 0, 10000),
    ("lymphocytes_percent", 0, 100),
    ("lymphocytes_absolute", 0, 500),
    ("magnesium", 0, 10),
    ("monocytes_percent", 0, 100),
    ("monocytes_absolute", 0, 500),
    ("neutrophils_percent", 0, 100),
    ("neutrophils_absolute", 0, 500),
    ("pco2_arterial", 0, 250),
    ("pco2_venous", 0, 250),
    ("pao2", 0, 200),
    ("ph_arterial", 6, 10),
    ("ph_venous", 5, 10),
    ("platelet_count", 0, 2000),
    ("potassium", 0, 15),
    ("procalcitonin", 0, 1000),
    ("pt", 1, 200),
    ("ptt", 1, 200),
    ("so2_arterial", 0, 100),
    ("so2_mixed_venous", 0, 100),
    ("so2_central_venous", 0, 100),
    ("sodium", 90, 210),
    ("total_protein", 0, 20),
    ("troponin_i", 0, 200),
    ("troponin_t", 0, 200),
    ("wbc", 0, 500),
]

# Plausible limits per vital sign of adults.
VITAL_LIMITS = [
    ("height_cm", 30, 96),
    ("weight_kg", 30, 1100),
    ("sbp", 0, 300),
    ("dbp", 0, 200),
    ("map", 0, 250),
    ("heart_rate", 0, 300),
    ("respiratory_rate", 0, 60),
    ("spo2", 50, 100),
    ("temp_c", 32, 44),
]

# Plausible limits per respiratory support column.
RESPIRATORY_LIMITS = [
    ("lpm_set", 0, 60),
    ("fio2_set", 0.21, 1),
    ("tidal_volume_set", 100, 3000),
    ("resp_rate_set", 0, 200),
    ("pressure_control_set", -50, 50),
    ("pressure_support_set", -50, 50),
    ("flow_rate_set", -50, 100),
    ("peak_inspiratory_pressure_set", -50, 100),
    ("inspiratory_time_set", -1, 50),
    ("peep_set", 0, 30),
    ("tidal_volume_obs", 100, 3000),
    ("resp_rate_obs", 0, 200),
    ("plateau_pressure_obs", 0, 100),
    ("peak_inspiratory_pressure_obs", -50, 100),
    ("peep_obs", 0, 50),
    ("minute_vent_obs", 0, 40),
    ("mean_airway_pressure_obs", 0, 50),
]

# Note concepts as (domain, group, name, pattern).
CONCEPTS = [
    ("all", "ici_agent", "pembrolizumab", r"\bkeytruda\b|\bpembrolizumab\b"),
    ("all", "ici_agent", "nivolumab", r"\bopdivo\b|\bnivolumab\b"),
    ("all", "ici_agent", "atezolizumab", r"\btecentriq\b|\batezolizumab\b"),
    ("all", "ici_agent", "durvalumab", r"\bimfinzi\b|\bdurvalumab\b"),
    ("all", "ici_agent", "ipilimumab", r"\byervoy\b|\bipilimumab\b"),
    ("all", "ici_agent", "cemiplimab", r"\blibtayo\b|\bcemiplimab\b"),
    ("all", "ici_agent", "avelumab", r"\bbavencio\b|\bavelumab\b"),
    ("all", "ici_agent", "tremelimumab", r"\btremelimumab\b|\bimjudo\b"),
    ("all", "ici_agent", "dostarlimab", r"\bdostarlimab\b|\bjemperli\b"),
    ("all", "ici_general", "checkpoint_inhibitor",
     r"checkpoint inhibitor|immune checkpoint inhibitor|ici\b|pd-1 inhibitor|pd-l1 inhibitor|ctla-4 inhibitor"),
    ("all", "ici_general", "immunotherapy", r"\bimmunotherapy\b"),
    ("all", "ici_general", "recent_treatment",
     r"last dose|last infusion|cycle\s*\d+|received .* immunotherapy|on .* pembrolizumab|on .* nivolumab"),
    ("all", "irae_general", "irae_term",
     r"immune related adverse event|immune-related adverse event|irae\b|immune toxicity|immunotherapy toxicity"
     r"|checkpoint toxicity"),
    ("all", "irae_general", "suspected_irae",
     r"suspect(ed)? .* irae|concern for .* irae|possible .* irae|favou?rs? .* irae|immune mediated toxicity"
     r"|treatment related toxicity"),
    ("all", "irae_pneumonitis", "pneumonitis",
     r"\bpneumonitis\b|immune mediated pneumonitis|checkpoint pneumonitis|organizing pneumonia from immunotherapy"),
    ("all", "irae_myocarditis", "myocarditis",
     r"\bmyocarditis\b|immune mediated myocarditis|checkpoint myocarditis"),
    ("all", "irae_hepatitis", "hepatitis",
     r"immune mediated hepatitis|checkpoint hepatitis|\bhepatitis\b due to immunotherapy"),
    ("all", "irae_colitis", "colitis",
     r"immune mediated colitis|checkpoint colitis|\bcolitis\b due to immunotherapy"),
    ("all", "irae_nephritis", "nephritis",
     r"immune mediated nephritis|checkpoint nephritis|\bnephritis\b due to immunotherapy"),
    ("all", "irae_endocrine", "endocrine",
     r"hypophysitis|adrenalitis|thyroiditis|immune mediated endocrinopathy|endocrine irae"),
    ("all", "irae_neuro", "neurologic",
     r"encephalitis|myasthenia|myositis|guillain|neurologic irae|immune mediated neurologic"),
    ("all", "irae_hlh", "hlh", r"\bhlh\b|hemophagocytic|cytokine storm|hyperinflammatory syndrome"),
    ("all", "competing_infection", "infection",
     r"\binfection\b|infectious|\bpneumonia\b|sepsis|bacteremia|fungal|viral|aspiration pneumonia"),
    ("all", "competing_progression", "progression",
     r"disease progression|tumor progression|malignant progression|lymphangitic carcinomatosis|progression of cancer"),
    ("all", "competing_edema", "edema",
     r"pulmonary edema|cardiogenic edema|volume overload|heart failure exacerbation|flash edema"),
    ("all", "competing_aspiration", "aspiration", r"aspiration|aspiration pneumonitis|aspiration event"),
    ("all", "treatment_steroid", "steroids",
     r"methylprednisolone|solumedrol|prednisone|prednisolone|dexamethasone|hydrocortisone|high dose steroids"
     r"|pulse steroids"),
    ("all", "treatment_rescue", "rescue_immunosuppression",
     r"infliximab|mycophenolate|tocilizumab|abatacept|rituximab|cyclophosphamide|ivig|immune globulin|plasmapheresis"),
    ("all", "qualifier_favoring", "favoring",
     r"favou?rs?|consistent with|compatible with|most likely|likely due to|high suspicion for"),
    ("all", "qualifier_uncertainty", "uncertainty",
     r"possible|possibly|concern for|cannot exclude|unclear|versus|v\.?s\.?|differential includes"),
    ("radiology", "radiology_supportive_pneumonitis", "ground_glass",
     r"ground\s*-?glass|ggo\b|bilateral ground glass"),
    ("radiology", "radiology_supportive_pneumonitis", "organizing_pneumonia",
     r"organizing pneumonia|cryptogenic organizing pneumonia|cop pattern"),
    ("radiology", "radiology_supportive_pneumonitis", "interstitial_pattern",
     r"diffuse interstitial|interstitial opacities|reticular opacities|multifocal opacities"),
    ("radiology", "radiology_supportive_pneumonitis", "airspace_pattern",
     r"multifocal consolidat|patchy consolidat|bilateral infiltrat|new infiltrat"),
    ("radiology", "radiology_infection", "infection_pattern",
     r"infectious process|multifocal pneumonia|lobar pneumonia|bronchopneumonia|tree-in-bud"),
    ("radiology", "radiology_edema", "edema_pattern",
     r"pulmonary edema|interstitial edema|vascular congestion|pleural effusions? with edema"),
    ("radiology", "radiology_progression", "progression_pattern",
     r"lymphangitic|progression of metastatic disease|worsening metastatic|tumor burden|masslike"),
]


def limits_table(spark: SparkSession, limits: list[tuple], key: str) -> DataFrame:
    """Limits as (key, lower_limit, upper_limit); its size is that of the constant list."""
    rows = [(name, float(low), float(high)) for name, low, high in limits]
    return spark.createDataFrame(rows, f"{key} string, lower_limit double, upper_limit double")


MAX_CONCEPTS = 10_000


def threshold_lookup(spark: SparkSession, path: str, key: str, strict: bool = True) -> DataFrame:
    """Limits from a CSV by column position: byte-order mark, spaces and stray text are tolerated."""
    raw = read_csv_required(spark, path, "name string, low string, high string")
    limits = raw.select(
        F.trim(F.regexp_replace("name", "﻿", "")).alias(key),
        F.trim("low").try_cast("double").alias("lower_limit"),
        F.trim("high").try_cast("double").alias("upper_limit"),
    )
    return require_unique(limits, [key]) if strict else limits


def require_unique(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Fail on a repeated key, which would silently repeat rows of the joined table."""
    repeated = lookup.groupBy(*keys).count().filter("count > 1").select(*keys).take(3)
    if repeated:
        raise ValueError(f"Lookup repeats the key {keys}: {[tuple(r) for r in repeated]}")
    return lookup


def read_concepts(spark: SparkSession, path: str) -> list[tuple[str, str, str, str]]:
    """Concept dictionary from a CSV, whose doubled backslashes mean single ones."""
    schema = "note_domain string, concept_group string, concept_name string, pattern string"
    rows = read_csv_required(spark, path, schema).limit(MAX_CONCEPTS + 1).collect()
    if len(rows) > MAX_CONCEPTS:
        raise ValueError(f"{path} has more than {MAX_CONCEPTS} rows; is it a concept dictionary?")
    return [(*row[:3], row[3] and row[3].replace("\\\\", "\\")) for row in rows]


def concept_patterns(concepts: Iterable[tuple[str, str, str, str]], domain: str) -> dict[str, str]:
    """One alternation per concept group over the rows of a domain and of ``all``."""
    groups: dict[str, list[str]] = {}
    for row_domain, group, _name, pattern in concepts:
        if row_domain in ("all", domain):
            patterns = groups.setdefault(group, [])
            if pattern not in patterns:
                patterns.append(pattern)
    return {group: "|".join(patterns) for group, patterns in groups.items()}


def concept_groups(concepts: Iterable[tuple[str, str, str, str]]) -> list[str]:
    return list(dict.fromkeys(group for _domain, group, _name, _pattern in concepts))
