"""Independent SQL for the registered queries, as one statement each over the driver's tables."""

from __future__ import annotations

import re

from clinical_views import VIEWS, duckdb_view
from oracle_constants import (
    CANCER_ICD9, CANCER_ICD10, LAB_ANALYTES, LAB_LIMITS, RESCUE_DRUGS, STEROIDS, SUPPORTIVE_DX, VASOPRESSORS, VITAL_LIMITS, VITAL_SIGNS,
)


def clean(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9.]+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '[\\t\\n\\f\\r\\p{{Z}}]+', ' ', 'g')))"


def squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\t\\n\\f\\r\\p{{Z}}]+', ' ', 'g'))"


def num(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '-?\\d+\\.?\\d*'), '') as double)"


def fips(x: str) -> str:
    digits = f"nullif(regexp_extract({x}, '\\d+'), '')"
    return f"case when length({digits}) < 5 then lpad({digits}, 5, '0') else {digits} end"


def any1(cond: str) -> str:
    return f"coalesce(max(cast(({cond}) as int)), 0)"


def drug(drugs: list[str]) -> str:
    return (
        f"(regexp_matches({clean('med_name')}, '{'|'.join(drugs)}') "
        f"or coalesce({clean('med_category')} in ({', '.join(repr(d) for d in drugs)}), false))"
    )


def days(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b}) / 86400e6"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def life(age: str) -> str:
    steps = [
        (20, 60.0), (25, 55.5), (30, 50.8), (35, 46.1), (40, 41.5), (45, 36.9), (50, 32.4), (55, 28.1), (60, 23.9),
        (65, 20.0), (70, 16.4), (75, 13.1), (80, 10.2), (85, 7.8), (90, 5.9),
    ]
    whens = " ".join(f"when {age} < {b} then cast({v} as double)" for b, v in steps)
    return f"case when {age} is null then null {whens} else cast(4.4 as double) end"


def limits(rows: list[tuple]) -> str:
    values = ", ".join(f"('{n}', cast({lo} as double), cast({hi} as double))" for n, lo, hi in rows)
    return f"select * from (values {values}) v(name, lower_limit, upper_limit)"


WINDOW = "e.{t} between b.first_icu_in - interval 24 hour and b.first_icu_in + interval {after} hour"


def windowed(view: str, t: str, after: int = 72) -> str:
    return f"{view} e join broad b using (hospitalization_id) where " + WINDOW.format(t=t, after=after)


MODULES = ["pulm_irae_like", "cardiac_irae_like", "hepatic_irae_like", "renal_irae_like", "hyperinflammatory_irae_like"]
POSSIBLE, PROBABLE, HIGH = (
    "possible_checkpoint_irae_icu", "probable_checkpoint_irae_icu", "high_confidence_checkpoint_irae_icu",
)
FILLED = [
    *SUPPORTIVE_DX, "any_imv", "any_hfnc", "any_nippv", "any_vasopressor", "any_crrt", "any_steroid",
    "any_rescue_immunosuppression", "inflam_marker_positive", "hepatitis_lab_positive", "myocarditis_lab_positive",
    "renal_lab_positive", "cytokine_storm_like", "fever_flag", "shock_vitals_flag", "hypoxemia_flag",
]

CODE = "upper(diagnosis_code)"
CANCER_MATCH = (
    f"((upper(diagnosis_code_format) = 'ICD10CM' and {rx(CODE, '|'.join(CANCER_ICD10))}) "
    f"or (upper(diagnosis_code_format) = 'ICD9CM' and {rx(CODE, '|'.join(CANCER_ICD9))}))"
)

_lab = ",\n  ".join(
    f"{kind}({num('lab_value')}) filter (where {rx(clean('lab_category'), p)} or {rx(clean('lab_name'), p)}) as {name}"
    for name, (kind, p) in LAB_ANALYTES.items()
)
_vital = ",\n  ".join(
    f"{kind}(try_cast(vital_value as double)) filter (where vital_category = '{sign}') as {name}"
    for name, (kind, sign) in VITAL_SIGNS.items()
)


def i(cond: str) -> str:
    return f"cast(coalesce({cond}, false) as int)"


CTES = {
    "icu_hosp": f"""select hospitalization_id, min(in_dttm) as first_icu_in, max(out_dttm) as last_icu_out,
  count(*) as n_icu_segments from adt where {clean('location_category')} = 'icu' group by 1""",
    "poa": f"""select hospitalization_id, 1 as poa_cancer,
  string_agg(distinct {CODE}, ' | ' order by {CODE}) as cancer_codes_poa
from hospital_diagnosis where poa_present = 1 and {CANCER_MATCH} group by 1""",
    "dx": "select hospitalization_id, " + ", ".join(f"{any1(rx(CODE, p))} as {n}" for n, p in SUPPORTIVE_DX.items())
    + " from hospital_diagnosis group by 1",
    "broad": """select * from hospitalization join icu_hosp using (hospitalization_id) join poa using (hospitalization_id)
where age_at_admission >= 18""",
    "resp": f"""select hospitalization_id, {any1(clean('device_category') + " = 'imv'")} as any_imv,
  {any1(clean('device_category') + " in ('high flow nc', 'hfnc')")} as any_hfnc,
  {any1(clean('device_category') + " in ('nippv', 'cpap', 'bipap')")} as any_nippv, max(fio2_set) as max_fio2
from {windowed('respiratory_support', 'recorded_dttm')} group by 1""",
    "vaso": f"""select hospitalization_id, {any1(drug(VASOPRESSORS))} as any_vasopressor
from {windowed('medication_admin_continuous', 'admin_dttm')} group by 1""",
    "crrt": f"""select distinct hospitalization_id, 1 as any_crrt from {windowed('crrt_therapy', 'recorded_dttm')}""",
    "steroid": f"""select hospitalization_id, {any1(drug(STEROIDS))} as any_steroid,
  {any1(rx(clean('med_name'), '|'.join(RESCUE_DRUGS)))} as any_rescue_immunosuppression,
  string_agg(distinct {clean('med_name')}, ' | ' order by {clean('med_name')}) filter (where {drug(STEROIDS)}) as steroid_names
from {windowed('medication_admin_intermittent', 'admin_dttm')}
  and (mar_action_group is null or {clean('mar_action_group')} = 'administered') group by 1""",
    "lab_values": f"""select hospitalization_id,
  {_lab}
from {windowed('labs', 'lab_result_dttm')} group by 1""",
    "lab": f"""select *, {i('ferritin_max >= 1000 or crp_max >= 10 or esr_max >= 50')} as inflam_marker_positive,
  {i('ast_max >= 200 or alt_max >= 200 or bili_max >= 2')} as hepatitis_lab_positive,
  {i('troponin_max > 0')} as myocarditis_lab_positive, {i('creat_max >= 2')} as renal_lab_positive,
  {i('ferritin_max >= 3000 or (ferritin_max >= 1000 and crp_max >= 10 and plt_min < 100)')} as cytokine_storm_like
from lab_values""",
    "vital": f"""select *, {i('temp_max >= 38')} as fever_flag, {i('map_min < 65')} as shock_vitals_flag,
  {i('spo2_min < 90')} as hypoxemia_flag
from (select hospitalization_id,
  {_vital}
from {windowed('vitals', 'recorded_dttm', 24)} group by 1) v""",
    "joined": "select * replace (" + ", ".join(f"coalesce({c}, 0) as {c}" for c in FILLED) + """)
from broad left join dx using (hospitalization_id) left join resp using (hospitalization_id)
left join vaso using (hospitalization_id) left join crrt using (hospitalization_id)
left join steroid using (hospitalization_id) left join lab using (hospitalization_id)
left join vital using (hospitalization_id)""",
    "counted": f"""select *, {' + '.join(SUPPORTIVE_DX)} as organ_dx_count,
  any_imv + any_vasopressor + any_crrt + cast(any_hfnc = 1 and hypoxemia_flag = 1 as int) as severe_support_count,
  inflam_marker_positive + hepatitis_lab_positive + myocarditis_lab_positive + renal_lab_positive
    + cytokine_storm_like + fever_flag as immune_signal_count
from joined""",
    "moduled": f"""select *, {' + '.join(MODULES)} as n_irae_modules from (select *,
  {i('(any_imv = 1 or any_hfnc = 1 or any_nippv = 1 or coalesce(spo2_min < 90, false) or coalesce(max_fio2 >= 60, false)) and any_steroid = 1')} as pulm_irae_like,
  {i('coalesce(troponin_max > 0, false) and (any_vasopressor = 1 or coalesce(lactate_max >= 2, false)) and any_steroid = 1')} as cardiac_irae_like,
  {i('(coalesce(ast_max >= 200, false) or coalesce(alt_max >= 200, false) or coalesce(bili_max >= 2, false)) and any_steroid = 1')} as hepatic_irae_like,
  {i('(coalesce(creat_max >= 2, false) or any_crrt = 1) and any_steroid = 1')} as renal_irae_like,
  {i('(coalesce(ferritin_max >= 1000, false) or coalesce(crp_max >= 10, false) or coalesce(esr_max >= 50, false) or cytokine_storm_like = 1) and (fever_flag = 1 or any_vasopressor = 1 or any_imv = 1) and any_steroid = 1')} as hyperinflammatory_irae_like
from counted) m""",
    "irae": f"""select *,
  cast(n_irae_modules >= 1 or (organ_dx_count >= 1 and any_steroid = 1 and severe_support_count >= 1) as int) as {POSSIBLE},
  cast((n_irae_modules >= 1 and (any_imv = 1 or any_vasopressor = 1 or any_crrt = 1))
    or (cytokine_storm_like = 1 and any_steroid = 1 and (any_imv = 1 or any_vasopressor = 1)) as int) as {PROBABLE},
  cast((n_irae_modules >= 2 or any_rescue_immunosuppression = 1)
    and (any_imv = 1 or any_vasopressor = 1 or any_crrt = 1) as int) as {HIGH}
from moduled""",
    "ana": f"""select *, 'SITE' as site_name, cast(year(admission_dttm) as int) as admit_year,
  cast(year(first_icu_in) as int) as icu_year, cast(month(first_icu_in) as int) as icu_month,
  strftime(first_icu_in, '%Y-%m') as icu_year_month,
  case when age_at_admission is null then null when age_at_admission < 40 then '18-39' when age_at_admission < 50 then '40-49'
    when age_at_admission < 60 then '50-59' when age_at_admission < 70 then '60-69' when age_at_admission < 80 then '70-79'
    else '80+' end as age_band,
  case when {HIGH} = 1 then 'high_confidence' when {PROBABLE} = 1 then 'probable' when {POSSIBLE} = 1 then 'possible'
    else 'not_flagged' end as phenotype_tier,
  {PROBABLE} as phenotype_primary, {POSSIBLE} as phenotype_any, {HIGH} as phenotype_high,
  {clean('discharge_name')} as discharge_name_clean, {clean('discharge_category')} as discharge_category_clean,
  cast({rx(clean('discharge_name'), 'death|expired|deceased')} or {rx(clean('discharge_category'), 'death|expired|deceased')} as int) as hospital_mortality,
  cast({rx(clean('discharge_name'), 'hospice')} or {rx(clean('discharge_category'), 'hospice')} as int) as hospice_discharge,
  cast({rx(clean('discharge_name'), 'home')} or {rx(clean('discharge_category'), 'home')} as int) as home_discharge,
  cast({rx(clean('discharge_name'), 'rehab|skilled|snf|ltach|facility|nursing')} or {rx(clean('discharge_category'), 'rehab|skilled|snf|ltach|facility|nursing')} as int) as facility_discharge,
  {days('admission_dttm', 'discharge_dttm')} as hospital_los_days, {days('first_icu_in', 'last_icu_out')} as icu_los_days,
  {i(days('admission_dttm', 'discharge_dttm') + ' >= 14')} as prolonged_hospital_los,
  {i(days('first_icu_in', 'last_icu_out') + ' >= 7')} as prolonged_icu_los,
  cast(any_imv = 1 or any_vasopressor = 1 or any_crrt = 1 as int) as any_major_support,
  case when {rx('cancer_codes_poa', 'C3[0-9]|C4[0-1]')} then 'respiratory_thoracic'
    when {rx('cancer_codes_poa', 'C1[5-9]|C2[0-1]|C26')} then 'gastrointestinal'
    when {rx('cancer_codes_poa', 'C5[0-8]')} then 'breast_female_genital'
    when {rx('cancer_codes_poa', 'C6[0-8]')} then 'genitourinary_male'
    when {rx('cancer_codes_poa', 'C8[1-9]|C9[0-6]')} then 'hematologic'
    when {rx('cancer_codes_poa', 'C4[3-9]')} then 'skin_soft_tissue' else 'other_or_mixed' end as cancer_type_broad,
  case {PROBABLE} when 1 then 'probable' when 0 then 'other_cancer_icu' end as exposure_label
from irae""",
    "yll_dead": f"select *, {life('age_at_admission')} as yll from ana where hospital_mortality = 1",
    "pm25": f"""select {fips('GEOID')} as county_code, cast(year as int) as icu_year, pm25_mean as pm25_annual, pm25_filled_2024
from pm25_county_year where year <= 2000""",
    "no2": f"""select {fips('GEOID')} as county_code, cast(year as int) as icu_year, no2_mean as no2_annual
from no2_county_year where year <= 2000""",
    "svi": f"""select {fips('GEOID')} as county_code, cast(year as int) as icu_year, cast(year_release as int) as svi_year_release,
  svi_overall, svi_theme1, svi_theme2, svi_theme3, svi_theme4 from svi_county_year where year <= 2000""",
    "linked": f"""select * from (select * replace ({fips('county_code')} as county_code) from ana where icu_year <= 2000) a
left join pm25 using (county_code, icu_year) left join no2 using (county_code, icu_year)
left join svi using (county_code, icu_year)""",
}


def _tile(value: str, name: str) -> str:
    return (
        f"case when {value} is not null then ['Q1 lowest', 'Q2', 'Q3', 'Q4 highest']"
        f"[ntile(4) over (partition by {value} is null order by {value}, hospitalization_id)] end as {name}"
    )


CTES["expo"] = f"""select *, {_tile('pm25_annual', 'pm25_q')}, {_tile('no2_annual', 'no2_q')}, {_tile('svi_overall', 'svi_q')}
from linked"""
CTES["prob"] = f"select *, {life('age_at_admission')} as yll_if_death from expo where phenotype_primary = 1"
CTES["ref"] = """select coalesce(quantile_cont(pm25_annual, 0.5) filter (where pm25_q = 'Q1 lowest'),
  quantile_cont(pm25_annual, 0.25)) as ref from prob"""
CTES["q_yll"] = """select pm25_q, count(*) as n_probable_cases, coalesce(cast(sum(hospital_mortality) as bigint), 0) as n_deaths,
  coalesce(sum(case when hospital_mortality = 1 then yll_if_death when hospital_mortality = 0 then 0 end), 0) as total_yll_observed
from prob where pm25_q is not null group by 1"""
CTES["q_rate"] = """select *, total_yll_observed / n_probable_cases as mean_yll_per_case,
  case when n_deaths > 0 then total_yll_observed / n_deaths end as mean_yll_per_death,
  (select total_yll_observed / n_probable_cases from q_yll where pm25_q = 'Q1 lowest') as baseline_yll_per_case_q1 from q_yll"""
CTES["q_full"] = """select *, baseline_yll_per_case_q1 * n_probable_cases as baseline_total_yll_q1_rate,
  mean_yll_per_case - baseline_yll_per_case_q1 as excess_yll_per_case_vs_q1,
  case when baseline_yll_per_case_q1 is not null then
    greatest(0, (mean_yll_per_case - baseline_yll_per_case_q1) * n_probable_cases) end as excess_total_yll_vs_q1,
  case when baseline_yll_per_case_q1 is not null then greatest(0, total_yll_observed
    - greatest(0, (mean_yll_per_case - baseline_yll_per_case_q1) * n_probable_cases)) end as observed_minus_excess
from q_rate"""

RATE = """cast({e} as double) / {n} as rate, sqrt(cast({e} as double) / {n} * (1 - cast({e} as double) / {n}) / {n}) as se,
  greatest(0, cast({e} as double) / {n} - 1.96 * sqrt(cast({e} as double) / {n} * (1 - cast({e} as double) / {n}) / {n})) as rate_low,
  least(1, cast({e} as double) / {n} + 1.96 * sqrt(cast({e} as double) / {n} * (1 - cast({e} as double) / {n}) / {n})) as rate_high"""
CTES["year_counts"] = """select icu_year, count(*) as n, coalesce(cast(sum(phenotype_primary) as bigint), 0) as cases,
  avg(pm25_annual) as pm25_mean from expo group by 1"""
CTES["year_rate"] = f"select *, {RATE.format(e='cases', n='n')} from year_counts"


def statement(final: str, floats: list[str] | None = None) -> str:
    """WITH clause of everything ``final`` needs, then ``final``, floats rounded."""
    texts = {**{name: duckdb_view(name) for name in VIEWS}, **CTES}
    needed: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in texts:
            if name in needed or name in path or not re.search(rf"\b{name}\b", text):
                continue
            visit(texts[name], (*path, name))
            if name not in needed:
                needed.append(name)

    visit(final, ())
    if floats:
        final = "select * replace (" + ", ".join(
            f"round(round({c}, 9), 6) as {c}" for c in floats
        ) + f") from ({final}) z"
    head = ",\n".join(f"{name} as ({texts[name]})" for name in needed)
    return f"with {head}\n{final}" if head else final
