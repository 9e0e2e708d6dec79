"""Clinical study tables derived from the driver's Parquet tables.

Each view is one SQL text that both Spark and DuckDB run; only the three-way
row expansion differs by name (``{k012}``). Ids stay bigint, no number is cast
to text unless it is whole, and every view covers its whole source table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.windows import hot_parts
from cohortspark.sources import io

SOURCES = ["nation", "customer", "orders", "lineitem", "documents", "conversations", "events", "labels"]

VIEWS = {
    "hospitalization": """
select o_orderkey as hospitalization_id, o_custkey as patient_id,
  o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) as admission_dttm,
  o_orderdate + INTERVAL '1' HOUR * (24 + o_orderkey % 600) as discharge_dttm,
  15 + o_custkey % 75 as age_at_admission,
  o_orderstatus as admission_type_name,
  case when o_orderkey % 11 = 0 then null else o_orderpriority end as admission_type_category,
  case o_orderkey % 7 when 0 then 'Patient Expired' when 3 then null else 'Discharged' end as discharge_name,
  case o_orderkey % 7 when 0 then 'Expired' when 1 then 'Hospice' when 2 then 'Skilled Nursing Facility (SNF)'
    when 4 then null else 'Home' end as discharge_category,
  cast(null as string) as zipcode_five_digit, cast(null as string) as zipcode_nine_digit,
  cast(null as string) as census_tract,
  case when o_orderkey % 29 = 0 then null else cast(c_nationkey * 1001 as string) end as county_code,
  cast(null as string) as state_code
from {orders} join {customer} on o_custkey = c_custkey""",
    "adt": """
select l_orderkey as hospitalization_id,
  case when l_suppkey % 41 = 0 then null else o_orderdate + INTERVAL '1' HOUR * (l_linenumber * 6) end as in_dttm,
  o_orderdate + INTERVAL '1' HOUR * (l_linenumber * 6 + 6 + l_suppkey % 50 * 5) as out_dttm,
  case l_returnflag when 'R' then 'ICU' when 'A' then 'Ward' else 'ER' end as location_category
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "hospital_diagnosis": """
select l_orderkey as hospitalization_id,
  case l_partkey % 16 when 0 then 'C34.11' when 1 then 'c50.9' when 2 then 'C91.0' when 3 then 'J84.10'
    when 4 then 'K72.00' when 5 then '162.9' when 6 then 'N17.9' when 7 then 'D76.1' when 8 then 'I51.4'
    when 9 then 'E11.9' when 10 then 'G93.1' when 11 then 'Z85.3' when 12 then 'C18.2' when 13 then 'R19.7'
    when 14 then null else 'I10' end as diagnosis_code,
  case when l_suppkey % 5 = 0 then 'icd9cm' else 'ICD10CM' end as diagnosis_code_format,
  case when l_linestatus = 'F' then 1 else 0 end as poa_present
from {lineitem}""",
    "labs": """
select hospitalization_id,
  o_orderdate + INTERVAL '1' HOUR * ((l_partkey * 7 + l_linenumber * 13 + k * 17) % 168 - 48) as lab_result_dttm,
  o_orderdate + INTERVAL '1' HOUR * ((l_partkey * 7 + l_linenumber * 13 + k * 17) % 168 - 49) as lab_collect_dttm,
  case (l_partkey + k) % 12 when 0 then 'ferritin' when 1 then 'CRP' when 2 then 'ESR' when 3 then 'Troponin-I'
    when 4 then 'ast' when 5 then 'ALT' when 6 then 'bilirubin_total' when 7 then 'creatinine' when 8 then 'lactate'
    when 9 then 'wbc' when 10 then 'eosinophils_absolute' else 'platelet_count' end as lab_category,
  case when l_suppkey % 23 = 0 then null else 'serum test' end as lab_name,
  case when l_suppkey % 17 = 0 then '<0.01' when l_suppkey % 19 = 0 then 'hemolyzed' when l_suppkey % 31 = 0 then null
    when (l_partkey + k) % 12 in (6, 7, 8)
      then concat(cast((l_suppkey * 13 + l_linenumber) % 5 as string), '.', cast(l_linenumber % 10 as string))
    when (l_partkey + k) % 12 = 0 then cast((l_suppkey * 97 + l_partkey) % 4000 as string)
    else cast((l_suppkey * 13 + l_partkey) % 300 as string) end as lab_value
from (select l_orderkey as hospitalization_id, l_partkey, l_suppkey, l_linenumber, o_orderdate, {k012} as k
  from {lineitem} join {orders} on l_orderkey = o_orderkey) t""",
    "vitals": """
select hospitalization_id,
  o_orderdate + INTERVAL '1' HOUR * ((l_partkey * 5 + l_linenumber * 11 + k * 7) % 96 - 24) as recorded_dttm,
  case (l_partkey + k) % 5 when 0 then 'temp_c' when 1 then 'heart_rate' when 2 then 'map' when 3 then 'spo2'
    else 'respiratory_rate' end as vital_category,
  case when l_suppkey % 37 = 0 then 'n/a'
    when (l_partkey + k) % 5 = 0 then concat(cast(35 + l_suppkey % 6 as string), '.', cast(l_partkey % 10 as string))
    else cast(50 + (l_suppkey * 7) % 60 as string) end as vital_value
from (select l_orderkey as hospitalization_id, l_partkey, l_suppkey, l_linenumber, o_orderdate, {k012} as k
  from {lineitem} join {orders} on l_orderkey = o_orderkey) t""",
    "respiratory_support": """
select l_orderkey as hospitalization_id,
  o_orderdate + INTERVAL '1' HOUR * ((l_partkey * 3 + l_linenumber * 17) % 144 - 36) as recorded_dttm,
  case l_suppkey % 7 when 0 then 'IMV' when 1 then 'High Flow NC' when 2 then 'NIPPV' when 3 then 'CPAP'
    when 4 then 'Room Air' when 5 then null else 'Nasal Cannula' end as device_category,
  case when l_partkey % 9 = 0 then null else cast(21 + l_partkey % 80 as double) end as fio2_set
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "crrt_therapy": """
select l_orderkey as hospitalization_id, o_orderdate + INTERVAL '1' HOUR * (l_linenumber * 12) as recorded_dttm
from {lineitem} join {orders} on l_orderkey = o_orderkey where l_discount >= 0.09""",
    "medication_admin_continuous": """
select l_orderkey as hospitalization_id,
  o_orderdate + INTERVAL '1' HOUR * ((l_suppkey * 3 + l_linenumber * 5) % 120 - 24) as admin_dttm,
  case l_partkey % 6 when 0 then 'NOREPINEPHRINE 8 mg/250mL' when 1 then null else 'Sodium Chloride 0.9%' end as med_name,
  case l_partkey % 6 when 1 then 'Vasopressin' when 2 then null else 'other' end as med_category
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "medication_admin_intermittent": """
select l_orderkey as hospitalization_id,
  o_orderdate + INTERVAL '1' HOUR * ((l_suppkey * 7 + l_linenumber * 3) % 120 - 24) as admin_dttm,
  case l_partkey % 8 when 0 then 'methylPREDNISolone 125 mg' when 1 then 'Dexamethasone' when 2 then 'Infliximab'
    when 3 then null else 'Acetaminophen' end as med_name,
  case l_partkey % 8 when 3 then 'hydrocortisone' when 4 then null else 'other' end as med_category,
  case l_suppkey % 6 when 0 then 'not_administered' when 1 then null else 'Administered' end as mar_action_group
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "patient": """
select c_custkey as patient_id,
  TIMESTAMP '1930-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey * 37 % 25000) as birth_date,
  case when c_custkey % 2 = 0 then 'Female' else 'Male' end as sex_category,
  c_mktsegment as race_category,
  case when c_custkey % 5 = 0 then null else 'Non-Hispanic' end as ethnicity_category,
  n_name as language_name
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "pm25_county_year": """
select distinct cast(n_nationkey * 1001 as string) as GEOID, year(o_orderdate) as year,
  5 + cast((n_nationkey * 37 + year(o_orderdate) * 11) % 97 as double) / 10 as pm25_mean,
  year(o_orderdate) >= 2000 as pm25_filled_2024
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
where n_regionkey <> 4""",
    "no2_county_year": """
select distinct cast(n_nationkey * 1001 as string) as GEOID, year(o_orderdate) as year,
  3 + cast((n_nationkey * 53 + year(o_orderdate) * 7) % 89 as double) / 10 as no2_mean
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
where n_regionkey <> 2""",
    "svi_county_year": """
select distinct cast(n_nationkey * 1001 as string) as GEOID, year(o_orderdate) as year,
  year(o_orderdate) as year_release,
  cast((n_nationkey * 41) % 100 as double) / 100 as svi_overall,
  cast((n_nationkey * 43) % 100 as double) / 100 as svi_theme1,
  cast((n_nationkey * 47) % 100 as double) / 100 as svi_theme2,
  cast((n_nationkey * 59) % 100 as double) / 100 as svi_theme3,
  cast((n_nationkey * 61) % 100 as double) / 100 as svi_theme4
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey""",
    "notes": """
select concat('M', cast(conv_id as string)) as MRN, concat('C', cast(conv_id as string)) as HAR,
  concat('C', cast(conv_id as string), '-', cast(turn as string)) as NOTE_ID,
  case role when 'user' then 'handp' else 'radiology' end as note_kind,
  case when turn = 0 then null when turn = 1 then 'not known'
    when turn = 2 then concat('01/0', cast(1 + conv_id % 9 as string), '/2024 ', cast(conv_id % 10 as string), ':30:15')
    else concat('2024-0', cast(1 + turn % 9 as string), '-1', cast(conv_id % 10 as string), ' 0',
      cast(turn as string), ':45') end as NOTE_DTTM,
  case when turn = 1 then '2024-07-04' end as SERVICE_DTTM,
  case when role = 'system' then 'CT HEAD' else 'XR CHEST 2V' end as PROC_NAME,
  text as NOTE_TEXT
from {conversations}
union all
select concat('S', source) as MRN, concat('D', source, lang) as HAR,
  concat('D', cast(doc_id as string)) as NOTE_ID,
  case when lang = 'en' then 'handp' else 'radiology' end as note_kind,
  case when n_chars < 500 then null
    else concat('2023-1', cast(n_chars % 3 as string), '-0', cast(1 + n_chars % 9 as string)) end as NOTE_DTTM,
  cast(null as string) as SERVICE_DTTM,
  case when lang = 'es' then 'CTA PE' else 'MR BRAIN' end as PROC_NAME,
  text as NOTE_TEXT
from {documents}""",
}

STUDY = [
    "hospitalization", "adt", "hospital_diagnosis", "labs", "vitals", "respiratory_support", "crrt_therapy",
    "medication_admin_continuous", "medication_admin_intermittent",
]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The join that the event views begin with, and the columns they take from it.
LINED = "{lineitem} join {orders} on l_orderkey = o_orderkey"
LINED_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount", "o_orderdate"]
#: Lines that one bucket of the stored join holds.
BUCKET_ROWS = 200_000


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """lineitem joined with orders, written once for all views that begin so, in buckets of the order.

    None, and each view joins for itself, if an order has so many lines that its bucket would be too large.
    """
    lines, orders = source(spark, sf_dir, "lineitem"), source(spark, sf_dir, "orders")
    if hot_parts(lines, "l_orderkey"):
        return None
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*LINED_COLUMNS)
    folder = f"{io.shared_dir(spark)}/cohortspark/lines-{uuid.uuid4().hex}"
    return io.save_laid_out({"lines": joined}, folder, "l_orderkey", io.bucket_count([lines], BUCKET_ROWS))["lines"]


def spark_view(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """A view; ``lines`` is the stored join, for callers that read several views which begin with it."""
    text = VIEWS[name].replace("{k012}", "explode(array(0, 1, 2))")
    if lines is not None:
        text = text.replace(LINED, "{lines}")
    used = {s: source(spark, sf_dir, s) for s in SOURCES if "{" + s + "}" in text}
    return spark.sql(text, **used, **({"lines": lines} if "{lines}" in text else {}))


def study_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = stored_lines(spark, sf_dir)
    return {name: spark_view(spark, sf_dir, name, lines) for name in STUDY}


def duckdb_view(name: str) -> str:
    text = VIEWS[name].replace("{k012}", "unnest([0, 1, 2])")
    return text.format(**{s: s for s in SOURCES})
