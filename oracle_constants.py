"""The constants that the SQL texts need, written out apart from the package so that both check each other."""

# Diagnosis code prefixes and groups.
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

# Drug, analyte and vital-sign vocabularies.
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

# Outlier limits.
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
