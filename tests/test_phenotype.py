import itertools
import random

from pyspark.sql import functions as F

from cohortspark.operators import anchors
from cohortspark.plans import phenotype

FLAGS = [
    "any_imv", "any_hfnc", "any_nippv", "any_vasopressor", "any_crrt", "any_steroid", "any_rescue_immunosuppression",
    "inflam_marker_positive", "hepatitis_lab_positive", "cytokine_storm_like", "fever_flag",
]


def test_modules_and_tiers_truth_table(spark):
    rng = random.Random(3)
    combos = list(itertools.product([0, 1], repeat=len(FLAGS)))
    values = [(rng.choice([None, 0.0, 1.5]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 1.9, 2.0]),
               rng.choice([None, 89.0, 90.0]), rng.choice([None, 59.9, 60.0]), rng.choice([0, 1]), rng.choice([0, 1]))
              for _ in combos]
    names = FLAGS + ["troponin_max", "lactate_max", "creat_max", "spo2_min", "max_fio2", "organ_dx_count", "severe_support_count"]
    kinds = ["int"] * len(FLAGS) + ["double"] * 5 + ["int"] * 2
    df = spark.createDataFrame(
        [(*c, *v) for c, v in zip(combos, values)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    )
    rows = phenotype.irae_tiers(phenotype.irae_modules(df)).collect()
    assert len(rows) == 2 ** len(FLAGS)
    rescue_only = 0
    for r in rows:
        steroid, major = r.any_steroid == 1, r.any_imv or r.any_vasopressor or r.any_crrt
        low = lambda x, b: x is not None and x < b
        high = lambda x, b: x is not None and x >= b
        pulm = steroid and (r.any_imv or r.any_hfnc or r.any_nippv or low(r.spo2_min, 90) or high(r.max_fio2, 60))
        card = steroid and r.troponin_max is not None and r.troponin_max > 0 and (r.any_vasopressor or high(r.lactate_max, 2))
        hepa = steroid and r.hepatitis_lab_positive
        rena = steroid and (high(r.creat_max, 2) or r.any_crrt)
        infl = steroid and (r.inflam_marker_positive or r.cytokine_storm_like) and (r.fever_flag or r.any_vasopressor or r.any_imv)
        modules = [int(bool(m)) for m in (pulm, card, hepa, rena, infl)]
        assert [r[m] for m in phenotype.ORGAN_MODULES] == modules and r.n_irae_modules == sum(modules)
        n = sum(modules)
        possible = n >= 1 or (r.organ_dx_count >= 1 and steroid and r.severe_support_count >= 1)
        probable = (n >= 1 and major) or (r.cytokine_storm_like and steroid and (r.any_imv or r.any_vasopressor))
        sure = (n >= 2 and major) or (r.any_rescue_immunosuppression and major)
        assert [r[t] for t in phenotype.TIERS] == [int(bool(x)) for x in (possible, probable, sure)]
        rescue_only += bool(sure and not possible)
    assert rescue_only > 0  # high confidence through rescue needs neither a module nor the possible tier


def test_anchors(spark):
    adt = spark.createDataFrame(
        [(1, None, None, "ICU"), (1, "2024-01-02 00:00:00", "2024-01-03 00:00:00", "icu "),
         (2, None, "2024-01-05 00:00:00", "ICU"), (3, "2024-01-01 00:00:00", None, "Ward")],
        "hospitalization_id bigint, in_dttm string, out_dttm string, location_category string",
    )
    got = {r.hospitalization_id: r for r in anchors.icu_anchor(adt).collect()}
    assert set(got) == {1, 2} and got[1].n_icu_segments == 2 and got[2].first_icu_in is None
    dx = spark.createDataFrame(
        [(1, "c50.9", "icd10cm", 1), (1, "C34.1", "ICD10CM", 1), (1, "C34.1", "ICD10CM", 1), (2, "162.9", "ICD10CM", 1),
         (3, "162.9", "ICD9CM", 1), (4, "C50", "ICD10CM", 0), (5, None, "ICD10CM", 1), (6, "Z85.3", None, 1)],
        "hospitalization_id bigint, diagnosis_code string, diagnosis_code_format string, poa_present int",
    )
    codes = {r.hospitalization_id: r.cancer_codes_poa for r in anchors.poa_cancer(dx).collect()}
    assert codes == {1: "C34.1 | C50.9", 3: "162.9"}
    flags = {r.hospitalization_id: r for r in anchors.dx_flags(dx).collect()}
    assert set(flags) == {1, 2, 3, 4, 5, 6} and all(flags[5][c] == 0 for c in anchors.SUPPORTIVE_DX)


def test_steroid_names_and_action(spark):
    meds = spark.createDataFrame(
        [(1, "Dexamethasone", None, None), (1, "methylPREDNISolone 125 mg", "other", "Administered"),
         (1, "Prednisone", None, "not_administered"), (2, None, "hydrocortisone", None), (2, "Infliximab", None, None)],
        "hospitalization_id bigint, med_name string, med_category string, mar_action_group string",
    ).withColumn("admin_dttm", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    base = spark.createDataFrame([(1,), (2,)], "hospitalization_id bigint").withColumn(
        "first_icu_in", F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    )
    got = {r.hospitalization_id: r for r in phenotype.steroid_rescue_features(meds, base).collect()}
    assert got[1].steroid_names == "dexamethasone | methylprednisolone 125 mg"
    assert (got[1].any_steroid, got[1].any_rescue_immunosuppression) == (1, 0)
    assert (got[2].any_steroid, got[2].any_rescue_immunosuppression, got[2].steroid_names) == (1, 1, None)
