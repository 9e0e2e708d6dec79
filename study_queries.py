"""The registered queries: each operator run over whole tables, with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles as o
from clinical_views import BUCKET_ROWS, STUDY, source, spark_view, stored_lines, study_tables
from cohortspark.functions import scalars as sc
from cohortspark.operators import anchors, models, outliers, quantiles, summaries, trajectories, windows
from cohortspark.plans import analysis, burden, exposure, inpatient, note_review, outcome_models, phenotype
from cohortspark.sources import io, lookups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MAX_YEAR = 2000
START, END = "1996-01-01", "1999-12-31"

# Words of the generated texts, mapped onto the concept groups of the notes.
TEST_CONCEPTS = [
    ("all", "ici_agent", "t1", "reand|worthless"),
    ("all", "ici_general", "t2", "under the .* license|tition"),
    ("all", "irae_general", "t3", "queque"),
    ("all", "irae_pneumonitis", "t4", "thering"),
    ("all", "irae_myocarditis", "t5", "verein"),
    ("all", "irae_hepatitis", "t6", "shhe"),
    ("all", "irae_neuro", "t7", "schst"),
    ("all", "competing_infection", "t8", "inging"),
    ("all", "competing_edema", "t9", "lich.{0,3}keit"),
    ("all", "treatment_steroid", "t10", "tionly"),
    ("all", "treatment_rescue", "t11", "andth"),
    ("all", "qualifier_favoring", "t12", "ention"),
    ("radiology", "radiology_supportive_pneumonitis", "t13", "eaux|MENT[a-z]* LA"),
    ("radiology", "radiology_infection", "t14", "attion"),
]
CONCEPTS = [*lookups.CONCEPTS, *TEST_CONCEPTS]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, first finely, so that a last-bit difference between engines cannot flip a half."""
    return df.select(
        *[
            F.round(F.round(F.col(f"`{f.name}`"), digits + 3), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def register(name: str, sql: str | None = None, floats: list[str] | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = o.statement(sql, floats=floats)
        return fn

    return wrap


def counted(df: DataFrame) -> DataFrame:
    """Distinct result rows with their counts (a whole-table check with a small result)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


def counted_sql(select: str, columns: str) -> str:
    return f"select {columns}, count(*) as n from ({select}) q group by all"


# Study data ----------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phenotype.irae_features(study_tables(spark, sf_dir))


def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analysis_dataset(features(spark, sf_dir))


def stored_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis table written once, for tables that read it more than once."""
    return io.materialize(analysis_table(spark, sf_dir))


def panels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Distinct by construction, so the linkage's key check is left to its own query."""
    return [spark_view(spark, sf_dir, f"{name}_county_year") for name in ("pm25", "no2", "svi")]


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.exposome_link(
        analysis_table(spark, sf_dir), *panels(spark, sf_dir), max_year=MAX_YEAR, strict=False
    )


def with_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.linked_with_quartiles(
        analysis_table(spark, sf_dir), *panels(spark, sf_dir), max_year=MAX_YEAR, strict=False
    )


def stored_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.materialize(with_quartiles(spark, sf_dir))


def probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.probable_yll(stored_quartiles(spark, sf_dir))


def anchor_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broad(spark, sf_dir).select("hospitalization_id", "first_icu_in")


def stored_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors written once, in as many buckets of the admission as they ask for."""
    rows = io.materialize(broad(spark, sf_dir, stored_lines(spark, sf_dir)).select("hospitalization_id", "first_icu_in"))
    folder = f"{io.shared_dir(spark)}/cohortspark/anchors-{uuid.uuid4().hex}"
    return io.save_laid_out({"anchors": rows}, folder, buckets=io.bucket_count([rows], BUCKET_ROWS))["anchors"]


def broad(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return phenotype.cancer_icu_broad(
        *[spark_view(spark, sf_dir, v, lines) for v in ("hospitalization", "adt", "hospital_diagnosis")]
    )


def note_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    notes = spark_view(spark, sf_dir, "notes")
    return (
        notes.filter(F.col("note_kind") == "handp").drop("note_kind"),
        notes.filter(F.col("note_kind") == "radiology").drop("note_kind"),
    )


def scored_notes(spark: SparkSession, sf_dir: str, concepts: list[tuple] = CONCEPTS, native: bool = False) -> DataFrame:
    return note_review.all_notes(*note_sources(spark, sf_dir), concepts=concepts, native=native)


def lab_limits(spark: SparkSession) -> DataFrame:
    return lookups.limits_table(spark, lookups.LAB_LIMITS, "lab_category")


def vital_limits(spark: SparkSession) -> DataFrame:
    return lookups.limits_table(spark, lookups.VITAL_LIMITS, "vital_category")


def numeric_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "labs").select(
        "hospitalization_id", "lab_category", outliers.parse_number(F.col("lab_value")).alias("lab_value_numeric")
    )


def numeric_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "vitals").select(
        "hospitalization_id", "vital_category", sc.try_num(F.col("vital_value")).alias("vital_value")
    )


# Sources and sinks ----------------------------------------------------------


@register(
    "read_optional",
    "select l_returnflag, count(*) as n, false as has_missing_table from lineitem group by 1",
)
def _(spark, sf):
    present = io.read_optional(spark, f"{sf}/lineitem.parquet")
    absent = io.read_optional(spark, f"{sf}/no_such_table.parquet")
    return present.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.lit(absent is not None).alias("has_missing_table")
    )


@register(
    "load_study_tables",
    "select 'orders' as table_name, count(*) as n from orders union all select 'customer', count(*) from customer "
    "union all select 'nation', count(*) from nation",
)
def _(spark, sf):
    tables = io.load_study_tables(spark, sf, ["orders", "customer", "nation"])
    io.require_tables(tables, ["orders", "customer", "nation"])
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return parts[0].union(parts[1]).union(parts[2])


@register(
    "optional_column",
    "select sum(cast(SERVICE_DTTM is not null as bigint))::bigint as n_service, 0::bigint as n_finalizing, "
    "count(*) as n from notes",
)
def _(spark, sf):
    notes = io.require_columns(spark_view(spark, sf, "notes"), note_review.RADIOLOGY_COLUMNS)
    return notes.agg(
        F.count(io.optional_column(notes, "SERVICE_DTTM")).alias("n_service"),
        F.count(io.optional_column(notes, "FINALIZING_DTTM")).alias("n_finalizing"),
        F.count(F.lit(1)).alias("n"),
    )


@register("write_read_csv", "select * from hospital_diagnosis")
def _(spark, sf):
    df = spark_view(spark, sf, "hospital_diagnosis")
    path = f"{io.shared_dir(spark)}/cohortspark/csv-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    io.write_table(df, path, "csv")
    return io.read_csv_required(spark, path, df.schema)


@register("notes_csv_round_trip", "select * from notes")
def _(spark, sf):
    """Every note, with its quotes and line breaks, written as CSV and read again."""
    notes = spark_view(spark, sf, "notes")
    path = f"{io.shared_dir(spark)}/cohortspark/notes-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    io.write_table(notes, path, "csv")
    return io.read_csv_required(spark, path, notes.schema)


@register(
    "threshold_lookup",
    "select lab_category, lower_limit, upper_limit, count(*) as n from labs left join "
    f"({o.limits(o.LAB_LIMITS)}) t on lab_category = name group by all",
)
def _(spark, sf):
    """Limits from a file, joined to the labs."""
    path = f"{io.shared_dir(spark)}/cohortspark/limits-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    io.write_table(lab_limits(spark).selectExpr("concat(' ', lab_category) as name", "lower_limit", "upper_limit"), path, "csv")
    limits = lookups.threshold_lookup(spark, path, "lab_category")
    return counted(spark_view(spark, sf, "labs").select("lab_category").join(limits, "lab_category", "left"))


@register(
    "write_read_parquet",
    "select location_category, count(*) as n, min(in_dttm) as first_in, max(out_dttm) as last_out from adt group by 1",
)
def _(spark, sf):
    path = f"{io.shared_dir(spark)}/cohortspark/adt-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    io.write_table(spark_view(spark, sf, "adt"), path)
    return (
        io.read_any(spark, path, "parquet")
        .groupBy("location_category")
        .agg(F.count(F.lit(1)).alias("n"), F.min("in_dttm").alias("first_in"), F.max("out_dttm").alias("last_out"))
    )


_SAVED = [name for name in STUDY if name != "hospitalization"]


@register(
    "save_cohort_tables",
    " union all ".join(
        f"select '{name}' as table_name, count(*) as n from {name} where hospitalization_id in (select hospitalization_id from broad)"
        for name in _SAVED
    ),
)
def _(spark, sf):
    lines = stored_lines(spark, sf)
    ids = io.materialize(broad(spark, sf, lines).select("hospitalization_id"))
    kept = {n: inpatient.semi_filter(spark_view(spark, sf, n, lines), ids) for n in _SAVED}
    folder = f"{io.shared_dir(spark)}/cohortspark/tables-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    parts = [
        spark.read.parquet(path).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        for name, path in io.save_cohort_tables(kept, folder).items()
    ]
    return reduce(DataFrame.unionAll, parts)


@register(
    "laid_out_join",
    "select v.hospitalization_id, n_vitals, n_labs from (select hospitalization_id, count(*) as n_vitals from vitals where hospitalization_id "
    "in (select hospitalization_id from broad) group by 1) v join (select hospitalization_id, count(*) as n_labs from labs group by 1) l using (hospitalization_id)",
)
def _(spark, sf):
    """Two tables saved in buckets of the admission, read back and joined where they lie."""
    lines = stored_lines(spark, sf)
    ids = io.materialize(broad(spark, sf, lines).select("hospitalization_id"))
    kept = {n: inpatient.semi_filter(spark_view(spark, sf, n, lines), ids) for n in ("vitals", "labs")}
    folder = f"{io.shared_dir(spark)}/cohortspark/laid-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    saved = io.save_laid_out(kept, folder, buckets=io.bucket_count(kept.values()))
    counts = [saved[n].groupBy("hospitalization_id").agg(F.count(F.lit(1)).alias(f"n_{n}")) for n in ("vitals", "labs")]
    return counts[0].join(counts[1], "hospitalization_id")


@register(
    "exposure_lookup",
    "select county_code, icu_year, pm25_annual, pm25_filled_2024 from pm25",
    ["pm25_annual"],
)
def _(spark, sf):
    return exposure.exposure_lookup(spark_view(spark, sf, "pm25_county_year"), exposure.PM25_COLUMNS, MAX_YEAR)


# Scalar expressions ---------------------------------------------------------

CLOCK_SQL = """coalesce(
  try_strptime({x}, '%Y-%m-%d %H:%M'), try_strptime({x}, '%m/%d/%Y %H:%M:%S'), try_strptime({x}, '%Y-%m-%d'))"""


def utc_sql(x: str) -> str:
    return f"timezone('UTC', timezone('America/Chicago', {CLOCK_SQL.format(x=x)}))"


NOTE_TIME_SQL = f"coalesce({utc_sql('NOTE_DTTM')}, {utc_sql('SERVICE_DTTM')})"


@register(
    "parse_dt",
    "select o_orderkey, o_orderdate as passed, o_orderdate as parsed from orders",
)
def _(spark, sf):
    orders = source(spark, sf, "orders")
    text = orders.withColumn("stamp", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return text.select(
        "o_orderkey",
        sc.parse_dt(text, "o_orderdate").alias("passed"),
        sc.parse_dt(text, "stamp").alias("parsed"),
    )


@register(
    "parse_flexible_datetime",
    counted_sql(f"select NOTE_DTTM, {utc_sql('NOTE_DTTM')} as note_utc from notes", "NOTE_DTTM, note_utc"),
)
def _(spark, sf):
    notes = spark_view(spark, sf, "notes")
    return counted(notes.select("NOTE_DTTM", sc.parse_flexible_datetime(F.col("NOTE_DTTM")).alias("note_utc")))


_DAY = {part: f"lpad(cast({part}(o_orderdate) as string), 2, '0')" for part in ("month", "day")}
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(3 * month(o_orderdate) - 2 as int), 3)"
#: Each order's date written in one of these forms: (text, hours from midnight UTC).
TIME_FORMS = [
    (f"concat(cast(year(o_orderdate) as string), '-', {_DAY['month']}, '-', {_DAY['day']}, 'T08:30:00-06:00')", 14.5),
    (f"concat(cast(year(o_orderdate) as string), '-', {_DAY['month']}, '-', {_DAY['day']}, ' 08:30:00Z')", 8.5),
    (f"concat({_MONTH}, ' ', cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string))", 0),
    (f"concat(cast(day(o_orderdate) as string), ' ', {_MONTH}, ' ', cast(year(o_orderdate) as string), ' 8:30')", 8.5),
    (f"concat(cast(year(o_orderdate) as string), {_DAY['month']}, {_DAY['day']})", 0),
    (f"concat(case when year(o_orderdate) between 1969 and 1999 then substr(cast(year(o_orderdate) as string), 3, 2) "
     f"else cast(year(o_orderdate) as string) end, '-', {_DAY['month']}, '-', {_DAY['day']})", 0),
]


@register(
    "parse_time_forms",
    "select o_orderkey, date_trunc('day', o_orderdate) + interval '1' minute * cast(60 * case o_orderkey % 6 "
    + " ".join(f"when {i} then {hours}" for i, (_, hours) in enumerate(TIME_FORMS))
    + " end as int) as utc from orders",
)
def _(spark, sf):
    """Offsets, month names, undelimited and two-digit years, by the parser of tables or that of notes."""
    form = F.col("o_orderkey") % 6
    text = F.coalesce(*[F.when(form == i, F.expr(sql)) for i, (sql, _) in enumerate(TIME_FORMS)])
    orders = source(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    parsed = F.when(form < 2, sc.parse_ymd_hms(F.col("t"))).otherwise(sc.parse_flexible_datetime(F.col("t"), "UTC"))
    return orders.select("o_orderkey", parsed.alias("utc"))


@register("note_datetime", f"select NOTE_ID, {NOTE_TIME_SQL} as note_datetime from notes")
def _(spark, sf):
    notes = spark_view(spark, sf, "notes")
    return notes.select("NOTE_ID", note_review.note_datetime(notes).alias("note_datetime"))


@register(
    "clean_string",
    counted_sql(f"select med_name, {o.clean('med_name')} as med_name_clean from medication_admin_intermittent",
                "med_name, med_name_clean"),
)
def _(spark, sf):
    meds = spark_view(spark, sf, "medication_admin_intermittent")
    return counted(meds.select("med_name", sc.clean_string(F.col("med_name")).alias("med_name_clean")))


@register("normalize_text", f"select NOTE_ID, {o.norm('NOTE_TEXT')} as note_text_clean from notes")
def _(spark, sf):
    return spark_view(spark, sf, "notes").select(
        "NOTE_ID", sc.normalize_text(F.col("NOTE_TEXT")).alias("note_text_clean")
    )


@register(
    "to_num",
    counted_sql(f"select lab_value, {o.num('lab_value')} as lab_value_num from labs", "lab_value, lab_value_num"),
)
def _(spark, sf):
    labs = spark_view(spark, sf, "labs")
    return counted(labs.select("lab_value", sc.to_num(F.col("lab_value")).alias("lab_value_num")))


@register(
    "tolerant_numeric_cast",
    counted_sql("select vital_value, try_cast(vital_value as double) as vital_value_num from vitals",
                "vital_value, vital_value_num"),
)
def _(spark, sf):
    vitals = spark_view(spark, sf, "vitals")
    return counted(vitals.select("vital_value", sc.try_num(F.col("vital_value")).alias("vital_value_num")))


@register(
    "parse_number",
    counted_sql(f"select lab_value, {o.num('lab_value')} as lab_value_numeric from labs",
                "lab_value, lab_value_numeric"),
)
def _(spark, sf):
    labs = spark_view(spark, sf, "labs")
    return counted(labs.select("lab_value", outliers.parse_number(F.col("lab_value")).alias("lab_value_numeric")))


@register(
    "upper_code",
    counted_sql("select upper(diagnosis_code) as diagnosis_code_clean, upper(diagnosis_code_format) as system "
                "from hospital_diagnosis", "diagnosis_code_clean, system"),
)
def _(spark, sf):
    dx = spark_view(spark, sf, "hospital_diagnosis")
    return counted(
        dx.select(
            sc.upper_code(F.col("diagnosis_code")).alias("diagnosis_code_clean"),
            sc.upper_code(F.col("diagnosis_code_format")).alias("system"),
        )
    )


@register(
    "pad_fips",
    counted_sql(f"select county_code as raw_code, {o.fips('county_code')} as county_code from hospitalization",
                "raw_code, county_code"),
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    return counted(
        hosp.select(F.col("county_code").alias("raw_code"), sc.pad_fips(F.col("county_code")).alias("county_code"))
    )


@register(
    "age_band",
    counted_sql("select age_at_admission, case when age_at_admission < 40 then '18-39' when age_at_admission < 50 then "
                "'40-49' when age_at_admission < 60 then '50-59' when age_at_admission < 70 then '60-69' "
                "when age_at_admission < 80 then '70-79' else '80+' end as age_band from hospitalization",
                "age_at_admission, age_band"),
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    return counted(hosp.select("age_at_admission", sc.age_band(F.col("age_at_admission")).alias("age_band")))


@register(
    "remaining_life_expectancy",
    counted_sql(f"select age_at_admission, {o.life('age_at_admission')} as years from hospitalization",
                "age_at_admission, years"),
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    return counted(
        hosp.select("age_at_admission", sc.remaining_life_expectancy(F.col("age_at_admission")).alias("years"))
    )


@register(
    "phenotype_tier",
    counted_sql("select possible_checkpoint_irae_icu as possible, probable_checkpoint_irae_icu as probable, "
                "high_confidence_checkpoint_irae_icu as high, phenotype_tier from ana",
                "possible, probable, high, phenotype_tier"),
)
def _(spark, sf):
    named = features(spark, sf).select(*[F.col(t).alias(s) for t, s in zip(phenotype.TIERS, ["possible", "probable", "high"])])
    return counted(
        named.withColumn("phenotype_tier", sc.phenotype_tier(F.col("high"), F.col("probable"), F.col("possible")))
    )


@register(
    "cancer_type_broad",
    counted_sql("select cancer_codes_poa, cancer_type_broad from ana", "cancer_codes_poa, cancer_type_broad"),
)
def _(spark, sf):
    cancer = broad(spark, sf)
    return counted(
        cancer.select("cancer_codes_poa", sc.cancer_type_broad(F.col("cancer_codes_poa")).alias("cancer_type_broad"))
    )


_DISCHARGE = {k: f"cast({o.rx(o.clean('discharge_name'), v)} or {o.rx(o.clean('discharge_category'), v)} as int)"
              for k, v in sc.DISCHARGE_KEYWORDS.items()}


@register(
    "discharge_flags",
    counted_sql("select discharge_name, discharge_category, " + ", ".join(f"{v} as {k}" for k, v in _DISCHARGE.items())
                + " from hospitalization", "discharge_name, discharge_category, " + ", ".join(_DISCHARGE)),
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    flags = {k: v for k, v in analysis.discharge_flags().items() if k in sc.DISCHARGE_KEYWORDS}
    return counted(hosp.select("discharge_name", "discharge_category", *[v.alias(k) for k, v in flags.items()]))


@register(
    "length_of_stay",
    "select hospitalization_id, hospital_los_days, icu_los_days, prolonged_hospital_los, prolonged_icu_los from ana",
    ["hospital_los_days", "icu_los_days"],
)
def _(spark, sf):
    stays = broad(spark, sf).withColumns(analysis.length_of_stay())
    return stays.select(
        "hospitalization_id", "hospital_los_days", "icu_los_days", "prolonged_hospital_los", "prolonged_icu_los"
    )


@register(
    "whole_day_los",
    counted_sql("select cast(date_diff('day', cast(admission_dttm as date), cast(discharge_dttm as date)) as int) as "
                "length_of_stay from hospitalization", "length_of_stay"),
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    return counted(
        hosp.select(sc.whole_days_between(F.col("admission_dttm"), F.col("discharge_dttm")).alias("length_of_stay"))
    )


@register(
    "age_at_date",
    f"select patient_id, date_diff('day', cast(birth_date as date), date '{START}') / 365.25::double as age from patient",
    ["age"],
)
def _(spark, sf):
    people = spark_view(spark, sf, "patient")
    return people.select(
        "patient_id", sc.age_at_date(F.to_date("birth_date"), F.lit(START).cast("date")).alias("age")
    )


@register(
    "icu_calendar",
    counted_sql("select icu_year, icu_month, icu_year_month from ana", "icu_year, icu_month, icu_year_month"),
)
def _(spark, sf):
    return counted(broad(spark, sf).select(*[v.alias(k) for k, v in analysis.icu_calendar(F.col("first_icu_in")).items()]))


@register(
    "any_major_support",
    counted_sql("select any_imv, any_vasopressor, any_crrt, any_major_support from ana",
                "any_imv, any_vasopressor, any_crrt, any_major_support"),
)
def _(spark, sf):
    flags = features(spark, sf).select("any_imv", "any_vasopressor", "any_crrt")
    return counted(flags.withColumn("any_major_support", analysis.any_major_support()))


@register(
    "age_cap",
    counted_sql("select case when age_at_admission <= 80 then age_at_admission end as age from hospitalization", "age"),
)
def _(spark, sf):
    return counted(spark_view(spark, sf, "hospitalization").select(sc.age_cap(F.col("age_at_admission"), 80).alias("age")))


@register(
    "rate_ci",
    "select county_code, n, events, " + o.RATE.format(e="events", n="n") + " from (select county_code, count(*) as n, "
    "coalesce(cast(sum(case when discharge_category = 'Expired' then 1 else 0 end) as bigint), 0) as events "
    "from hospitalization group by 1) c",
    ["rate", "se", "rate_low", "rate_high"],
)
def _(spark, sf):
    counts = spark_view(spark, sf, "hospitalization").groupBy("county_code").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("discharge_category") == "Expired", 1)).alias("events")
    )
    return counts.withColumns(sc.rate_with_ci(F.col("events"), F.col("n")))


def letters_sql(x: str) -> str:
    """Accented letters as underscores: the oracle's word boundaries know ASCII only; lengths stay."""
    return f"regexp_replace({x}, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def snippet_sql(x: str, pattern: str, searched: str | None = None) -> str:
    y = searched or letters_sql(x)
    before = f"length(string_split_regex({y}, '(?i){pattern}')[1])"
    found = f"length(regexp_extract({y}, '(?i)({pattern})'))"
    start = f"greatest(1, {before} + 1 - 90)"
    stop = f"least(length({x}), {before} + {found} + 90)"
    cut = f"substring({x}, cast({start} as bigint), cast({stop} - {start} + 1 as bigint))"
    return f"case when regexp_matches({y}, '(?i){pattern}') then {o.squish(cut)} end"


@register(
    "extract_snippet",
    "select NOTE_ID, " + snippet_sql("NOTE_TEXT", "THTION|queque") + " as snippet from notes",
)
def _(spark, sf):
    return spark_view(spark, sf, "notes").select(
        "NOTE_ID", sc.extract_snippet(F.col("NOTE_TEXT"), "THTION|queque").alias("snippet")
    )


@register("optional_block_fillers", "select hospitalization_id, 0 as any_imv, 0 as any_hfnc, 0 as any_nippv, "
          "cast(null as double) as max_fio2, 0 as any_vasopressor, 0 as any_crrt, 0 as fever_flag, "
          "cast(null as double) as ferritin_max from broad")
def _(spark, sf):
    # stored in buckets of the key: the blocks read it five times more, and then join it where it lies
    base = stored_anchors(spark, sf)
    blocks = [
        phenotype.resp_features(None, base),
        phenotype.vasopressor_features(None, base),
        phenotype.crrt_features(None, base),
        phenotype.vital_features(None, base).select("hospitalization_id", "fever_flag"),
        phenotype.lab_features(None, base).select("hospitalization_id", "ferritin_max"),
    ]
    return phenotype.feature_assembly(base.select("hospitalization_id"), blocks)


# Filters --------------------------------------------------------------------


@register("adult_filter", "select hospitalization_id, age_at_admission from hospitalization where age_at_admission >= 18")
def _(spark, sf):
    return phenotype.adult_filter(spark_view(spark, sf, "hospitalization")).select("hospitalization_id", "age_at_admission")


@register(
    "category_filter",
    "select distinct hospitalization_id from adt where location_category in ('Ward', 'ICU')",
)
def _(spark, sf):
    return inpatient.category_ids(spark_view(spark, sf, "adt"))


@register(
    "code_prefix_match",
    counted_sql(f"select diagnosis_code, diagnosis_code_format from hospital_diagnosis where {o.CANCER_MATCH}",
                "diagnosis_code, diagnosis_code_format"),
)
def _(spark, sf):
    dx = spark_view(spark, sf, "hospital_diagnosis")
    match = anchors.code_prefix_match(
        sc.upper_code(F.col("diagnosis_code")), sc.upper_code(F.col("diagnosis_code_format")), anchors.CANCER_CODES
    )
    return counted(dx.filter(match).select("diagnosis_code", "diagnosis_code_format"))


@register(
    "administered_filter",
    counted_sql(f"select mar_action_group, med_name from medication_admin_intermittent where mar_action_group is null "
                f"or {o.clean('mar_action_group')} = 'administered'", "mar_action_group, med_name"),
)
def _(spark, sf):
    meds = spark_view(spark, sf, "medication_admin_intermittent")
    return counted(meds.filter(phenotype.administered(F.col("mar_action_group"))).select("mar_action_group", "med_name"))


@register(
    "date_range_cohort",
    f"select hospitalization_id from hospitalization where admission_dttm between timestamp '{START}' and timestamp '{END}'",
)
def _(spark, sf):
    return inpatient.date_range_cohort(spark_view(spark, sf, "hospitalization"), START, END).select("hospitalization_id")


CHEST_SQL = (
    f"({o.rx(o.norm('PROC_NAME'), note_review.CHEST_PROCEDURE)} or {o.rx(o.norm('NOTE_TEXT'), note_review.CHEST_TEXT)})"
)


@register("chest_filter", f"select NOTE_ID, PROC_NAME from notes where note_kind = 'radiology' and {CHEST_SQL}")
def _(spark, sf):
    return note_review.radiology_filter(note_sources(spark, sf)[1]).select("NOTE_ID", "PROC_NAME")


@register("suspected", "select hospitalization_id, n_irae_modules from irae where possible_checkpoint_irae_icu = 1")
def _(spark, sf):
    return phenotype.checkpoint_suspected(features(spark, sf)).select("hospitalization_id", "n_irae_modules")


@register(
    "complete_cases",
    "select hospital_mortality, pm25_annual, svi_overall, count(*) as n from linked where hospital_mortality is not null "
    "and pm25_annual is not null and svi_overall is not null group by all",
    ["pm25_annual", "svi_overall"],
)
def _(spark, sf):
    return counted(models.complete_cases(linked(spark, sf), ["hospital_mortality", "pm25_annual", "svi_overall"]))


# Anchors and joins ----------------------------------------------------------


@register("icu_anchor", "select * from icu_hosp")
def _(spark, sf):
    return anchors.icu_anchor(spark_view(spark, sf, "adt"))


@register("poa_cancer", "select * from poa")
def _(spark, sf):
    return anchors.poa_cancer(spark_view(spark, sf, "hospital_diagnosis"))


@register("dx_flags", "select * from dx")
def _(spark, sf):
    return anchors.dx_flags(spark_view(spark, sf, "hospital_diagnosis"))


@register(
    "cohort_inner",
    "select hospitalization_id, patient_id, age_at_admission, first_icu_in, last_icu_out, n_icu_segments, cancer_codes_poa "
    "from broad",
)
def _(spark, sf):
    return phenotype.cohort_inner(
        spark_view(spark, sf, "hospitalization"),
        anchors.icu_anchor(spark_view(spark, sf, "adt")),
        anchors.poa_cancer(spark_view(spark, sf, "hospital_diagnosis")),
    ).select(
        "hospitalization_id", "patient_id", "age_at_admission", "first_icu_in", "last_icu_out", "n_icu_segments",
        "cancer_codes_poa",
    )


@register("cancer_icu_broad", "select * from broad")
def _(spark, sf):
    return broad(spark, sf)


@register(
    "anchored_interval_join",
    "select e.hospitalization_id, recorded_dttm, vital_category, vital_value, first_icu_in from "
    + o.windowed("vitals", "recorded_dttm", 24),
)
def _(spark, sf):
    vitals = spark_view(spark, sf, "vitals")
    return windows.anchored_interval_join(vitals, anchor_frame(spark, sf), "recorded_dttm", after_hours=24)


@register(
    "anchored_window_events",
    """with a as (select user_id, min(ts) as t0 from events where event_type = 'error' group by 1)
select e.user_id, max(case when event_type = 'purchase' then value end) as purchase_max,
  min(case when event_type = 'view' then value end) as view_min,
  coalesce(max(cast(event_type = 'click' as int)), 0) as any_click
from events e join a using (user_id) where e.ts between t0 - interval 24 hour and t0 + interval 72 hour group by 1""",
    ["purchase_max", "view_min"],
)
def _(spark, sf):
    events = source(spark, sf, "events")
    first_error = events.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.min("ts").alias("t0"))
    kind = F.col("kind")
    return windows.anchored_features(
        events.select("user_id", "ts", "event_type", "value"),
        first_error,
        "ts",
        {"kind": F.col("event_type")},
        [
            windows.Feature("purchase_max", "max", kind == "purchase"),
            windows.Feature("view_min", "min", kind == "view"),
            windows.Feature("any_click", "any", kind == "click"),
        ],
        number="value",
        key="user_id",
        anchor="t0",
    )


@register(
    "threshold_join",
    "select lab_category, lower_limit, upper_limit, count(*) as n from labs left join "
    f"({o.limits(o.LAB_LIMITS)}) t on lab_category = name group by all",
)
def _(spark, sf):
    labs = spark_view(spark, sf, "labs").select("lab_category")
    return counted(labs.join(lab_limits(spark), "lab_category", "left"))


@register("semi_filter", "select * from crrt_therapy where hospitalization_id in (select hospitalization_id from broad)")
def _(spark, sf):
    return inpatient.semi_filter(spark_view(spark, sf, "crrt_therapy"), broad(spark, sf))


# Phenotype ------------------------------------------------------------------

#: (table, column of the standardised table, the same in SQL)
_STANDARD = [
    ("adt", "in_dttm", "in_dttm"), ("adt", "out_dttm", "out_dttm"), ("adt", "location_category", o.clean("location_category")),
    ("hospitalization", "admission_dttm", "admission_dttm"), ("hospitalization", "discharge_dttm", "discharge_dttm"),
    ("hospital_diagnosis", "diagnosis_code_clean", "upper(diagnosis_code)"),
    ("hospital_diagnosis", "diagnosis_code_format", "upper(diagnosis_code_format)"),
    ("labs", "lab_result_dttm", "lab_result_dttm"), ("labs", "lab_collect_dttm", "lab_collect_dttm"),
    ("labs", "lab_value_num", o.num("lab_value")), ("labs", "lab_category_clean", o.clean("lab_category")),
    ("labs", "lab_name_clean", o.clean("lab_name")),
    ("vitals", "recorded_dttm", "recorded_dttm"), ("vitals", "vital_category_clean", o.clean("vital_category")),
    ("vitals", "vital_value_num", "try_cast(vital_value as double)"),
    ("respiratory_support", "recorded_dttm", "recorded_dttm"),
    ("respiratory_support", "device_category_clean", o.clean("device_category")), ("respiratory_support", "fio2_set_num", "fio2_set"),
    ("crrt_therapy", "recorded_dttm", "recorded_dttm"),
    *[(t, *c) for t in ("medication_admin_continuous", "medication_admin_intermittent") for c in (
        ("admin_dttm", "admin_dttm"), ("med_name_clean", o.clean("med_name")), ("med_category_clean", o.clean("med_category")))],
    ("medication_admin_intermittent", "mar_action_group_clean", o.clean("mar_action_group")),
]


@register(
    "standardize_tables",
    " union all ".join(
        f"select '{t}' as t, '{c}' as c, count({e}) as n_known, count(distinct {e}) as n_distinct from {t}" for t, c, e in _STANDARD
    ),
)
def _(spark, sf):
    """Known and distinct values of every standardised column of all nine tables."""
    tables = phenotype.standardize_tables(study_tables(spark, sf))
    parts = []
    for name, table in tables.items():
        columns = [c for t, c, _ in _STANDARD if t == name]
        counts = table.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("d", F.count_distinct))])
        rows = [F.struct(F.lit(name).alias("t"), F.lit(c).alias("c"), F.col(f"n_{c}").alias("n_known"), F.col(f"d_{c}").alias("n_distinct")) for c in columns]
        parts.append(counts.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionAll, parts)


def _block(name: str, view: str, fn, sql: str, floats: list[str] | None = None):
    @register(name, sql, floats)
    def _(spark, sf):
        return fn(spark_view(spark, sf, view), io.materialize(anchor_frame(spark, sf)))


_block("resp_features", "respiratory_support", phenotype.resp_features, "select * from resp", ["max_fio2"])
_block("vasopressor_features", "medication_admin_continuous", phenotype.vasopressor_features, "select * from vaso")
_block("crrt_features", "crrt_therapy", phenotype.crrt_features, "select * from crrt")
_block("steroid_rescue_features", "medication_admin_intermittent", phenotype.steroid_rescue_features,
       "select * from steroid")
_block("lab_features", "labs", phenotype.lab_features, "select * from lab_values", list(phenotype.LAB_ANALYTES))
_block("lab_flags", "labs", lambda t, a, **w: phenotype.lab_flags(phenotype.lab_features(t, a, **w)),
       "select * from lab", list(phenotype.LAB_ANALYTES))
_block("vital_features", "vitals", phenotype.vital_features, "select * from vital", list(phenotype.VITAL_SIGNS))


@register(
    "irae_lab_window",
    "select hospitalization_id, ferritin_max, troponin_max, creat_max, inflam_marker_positive, myocarditis_lab_positive, "
    "renal_lab_positive from lab",
    ["ferritin_max", "troponin_max", "creat_max"],
)
def _(spark, sf):
    rows = io.materialize(anchor_frame(spark, sf))
    labs = phenotype.lab_flags(phenotype.lab_features(spark_view(spark, sf, "labs"), rows))
    return labs.select(
        "hospitalization_id", "ferritin_max", "troponin_max", "creat_max", "inflam_marker_positive",
        "myocarditis_lab_positive", "renal_lab_positive",
    )


_COUNTS = ["organ_dx_count", "severe_support_count", "immune_signal_count"]


def _per_stay(name: str, columns: list[str], floats: list[str] | None = None):
    @register(name, f"select hospitalization_id, {', '.join(columns)} from irae", floats)
    def _(spark, sf):
        return features(spark, sf).select("hospitalization_id", *columns)


_per_stay("feature_assembly",
          ["any_imv", "any_vasopressor", "any_crrt", "any_steroid", "steroid_names", "ferritin_max", "spo2_min",
           "max_fio2", "dx_colitis"], ["ferritin_max", "spo2_min", "max_fio2"])
_per_stay("irae_features", _COUNTS)
_per_stay("irae_modules", [*phenotype.ORGAN_MODULES, "n_irae_modules"])
_per_stay("irae_tiers", phenotype.TIERS)


@register(
    "phenotype_summary_counts",
    "select count(*) as n_cancer_icu_broad, "
    + ", ".join(f"cast(sum({c}) as bigint) as n_{c}" for c in [*phenotype.TIERS, *phenotype.ORGAN_MODULES]) + " from irae",
)
def _(spark, sf):
    return phenotype.phenotype_summary_counts(features(spark, sf))


@register(
    "checkpoint_suspected",
    "select hospitalization_id, n_irae_modules, steroid_names from irae where possible_checkpoint_irae_icu = 1",
)
def _(spark, sf):
    return phenotype.checkpoint_suspected(features(spark, sf)).select(
        "hospitalization_id", "n_irae_modules", "steroid_names"
    )


# Analysis table, burden, descriptive tables ----------------------------------


@register(
    "analysis_dataset",
    "select " + ", ".join(analysis.ANALYSIS_COLUMNS) + " from ana",
    ["max_fio2", *phenotype.LAB_ANALYTES, *phenotype.VITAL_SIGNS, "hospital_los_days", "icu_los_days"],
)
def _(spark, sf):
    return analysis_table(spark, sf)


def _from_analysis(name: str, fn, sql: str, floats: list[str] | None = None, stored: bool = False):
    @register(name, sql, floats)
    def _(spark, sf):
        return fn((stored_analysis if stored else analysis_table)(spark, sf))


_SHORT = burden.SHORT
_TIER_SUMS = ", ".join(f"cast(sum({t}) as bigint) as n_{s}" for t, s in zip(phenotype.TIERS, _SHORT))
_RATES = ", ".join(
    f"100 * cast(n_{s} as double) / n_denominator as pct_{s}, 1000 * cast(n_{s} as double) / n_denominator as rate_{s}_per_1000"
    for s in _SHORT
)
_RATE_NAMES = [n for s in _SHORT for n in (f"pct_{s}", f"rate_{s}_per_1000")]

_from_analysis("denominators_overall", burden.denominators_overall,
               "select site_name, 'cancer_icu_broad' as denominator_name, count(*) as n from ana group by 1, 2")
_from_analysis("denominators_yearly", burden.denominators_yearly,
               "select site_name, icu_year, 'cancer_icu_broad' as denominator_name, count(*) as n from ana group by 1, 2, 3")
_from_analysis(
    "qc_summary", burden.qc_summary,
    f"select site_name, count(*) as n_cancer_icu_broad, {_TIER_SUMS}, avg(hospital_mortality) as hospital_mortality_overall, "
    "avg(hospital_mortality) filter (where phenotype_primary = 1) as hospital_mortality_probable from ana group by 1",
    ["hospital_mortality_overall", "hospital_mortality_probable"],
)
_from_analysis(
    "burden_overall", burden.burden_overall,
    f"select *, {_RATES} from (select site_name, 'cancer_icu_broad' as denominator, count(*) as n_denominator, {_TIER_SUMS} "
    "from ana group by 1, 2) b", _RATE_NAMES,
)
_YEARLY = (
    f"select *, {_RATES} from (select site_name, icu_year, 'cancer_icu_broad' as denominator_name, "
    f"count(*) as n_denominator, {_TIER_SUMS} from ana group by 1, 2, 3) b"
)
_from_analysis("burden_yearly", burden.burden_yearly, _YEARLY, _RATE_NAMES)
_from_analysis("rate_join", lambda d: burden.burden_yearly(d, burden.denominators_yearly(d)), _YEARLY, _RATE_NAMES,
               stored=True)
_from_analysis(
    "module_prevalence", burden.module_prevalence,
    " union all ".join(
        f"select '{m}' as module, cast(sum({m}) filter (where probable_checkpoint_irae_icu = 1) as bigint) as n, "
        f"cast(sum(probable_checkpoint_irae_icu) as bigint) as denominator, "
        f"100.0::double * sum({m}) filter (where probable_checkpoint_irae_icu = 1) / sum(probable_checkpoint_irae_icu) as pct from ana"
        for m in phenotype.ORGAN_MODULES
    ),
    ["pct"],
)
_from_analysis("tier_counts", burden.tier_counts, "select phenotype_tier, count(*) as n from ana group by 1")


def binary_sql(variables: list[str], label: str, table: str = "ana", by: str = "exposure_label") -> str:
    return " union all ".join(
        f"select {by}, '{v}' as {label}, count(*) as n, count(*) filter (where {v} = 1) as events, "
        f"100.0::double * count(*) filter (where {v} = 1) / count(*) as pct from {table} group by 1"
        for v in variables
    )


def continuous_sql(variables: list[str], label: str, table: str = "ana", by: str = "exposure_label") -> str:
    return " union all ".join(
        f"select {by}, '{v}' as {label}, count({v}) as n_nonmissing, avg({v}) as mean, stddev_samp({v}) as sd, "
        f"cast(min({v}) as double) as min, cast(max({v}) as double) as max, "
        f"quantile_cont(cast({v} as double), 0.25) as p25, quantile_cont(cast({v} as double), 0.5) as median, "
        f"quantile_cont(cast({v} as double), 0.75) as p75 from {table} group by 1"
        for v in variables
    )


CONT = ["mean", "sd", "min", "max", "p25", "median", "p75"]
_from_analysis("outcome_desc_binary", burden.outcome_desc_binary, binary_sql(burden.BINARY_OUTCOMES, "outcome"), ["pct"])
_from_analysis("outcome_desc_continuous", burden.outcome_desc_continuous,
               continuous_sql(burden.CONTINUOUS_OUTCOMES, "outcome"), CONT, stored=True)
_from_analysis("table1_binary", burden.table1_binary, binary_sql(burden.TABLE1_BINARY, "variable"), ["pct"])
_from_analysis("table1_continuous", burden.table1_continuous, continuous_sql(burden.TABLE1_CONTINUOUS, "variable"), CONT,
               stored=True)
_from_analysis(
    "sensitivity_by_tier", burden.sensitivity_by_tier,
    "select phenotype_tier, count(*) as n, 100 * avg(hospital_mortality) as hospital_mortality_pct, "
    "100 * avg(any_imv) as any_imv_pct, 100 * avg(any_vasopressor) as any_vasopressor_pct, 100 * avg(any_crrt) as any_crrt_pct, "
    "quantile_cont(hospital_los_days, 0.5) as median_hospital_los, quantile_cont(icu_los_days, 0.5) as median_icu_los "
    "from ana where phenotype_tier <> 'not_flagged' group by 1",
    ["hospital_mortality_pct", "any_imv_pct", "any_vasopressor_pct", "any_crrt_pct", "median_hospital_los", "median_icu_los"],
    stored=True,
)

_YLL = ("count(*) as n_deaths, coalesce(sum(yll), 0) as total_yll, avg(yll) as mean_yll_per_death, "
        "quantile_cont(yll, 0.5) as median_yll_per_death")
_YLL_F = ["total_yll", "mean_yll_per_death", "median_yll_per_death"]
_from_analysis("yll_overall", burden.yll_overall, f"select {_YLL} from yll_dead", _YLL_F, stored=True)
_from_analysis("yll_by_exposure", burden.yll_by_exposure,
               f"select case when probable_checkpoint_irae_icu = 1 then 'probable' else 'other_cancer_icu' end as "
               f"exposure_label, {_YLL} from yll_dead group by 1", _YLL_F, stored=True)
_from_analysis("yll_by_tier", burden.yll_by_tier,
               f"select phenotype_tier, {_YLL} from yll_dead where phenotype_tier <> 'not_flagged' group by 1", _YLL_F,
               stored=True)
_CASES = " union all ".join(
    f"select '{s}' as \"group\", cast(sum({t}) as bigint) as n_cases, coalesce((select sum(yll) from yll_dead "
    f"where phenotype_tier = '{s}'), 0) as total_yll from ana" for t, s in zip(phenotype.TIERS, _SHORT)
)
_from_analysis("yll_per_case", burden.yll_per_case,
               f"select *, total_yll / nullif(n_cases, 0) as yll_per_case from ({_CASES}) c", ["total_yll", "yll_per_case"])


@register(
    "summarise_binary",
    binary_sql(["quality", "toxic"], "variable", "(select lang, quality, toxic from documents left join labels using (doc_id))",
               "lang"),
    ["pct"],
)
def _(spark, sf):
    labelled = source(spark, sf, "documents").select("doc_id", "lang").join(source(spark, sf, "labels"), "doc_id", "left")
    return summaries.binary_table(labelled, ["quality", "toxic"], ["lang"])


@register(
    "summarise_continuous",
    continuous_sql(["l_quantity", "l_extendedprice"], "variable", "lineitem", "l_returnflag"), CONT,
)
def _(spark, sf):
    return summaries.continuous_table(
        source(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]
    )


@register(
    "category_summary",
    "select event_type, count(value) as \"N\", min(value) as \"Min\", max(value) as \"Max\", avg(value) as \"Mean\", "
    "quantile_cont(value, 0.5) as \"Median\", quantile_cont(value, 0.25) as \"First_Quartile\", "
    "quantile_cont(value, 0.75) as \"Third_Quartile\" from events group by 1",
    ["\"Min\"", "\"Max\"", "\"Mean\"", "\"Median\"", "\"First_Quartile\"", "\"Third_Quartile\""],
)
def _(spark, sf):
    return summaries.category_summary(source(spark, sf, "events"), "event_type", "value")


@register(
    "mode_value",
    "select location_category, mode_value, n from (select location_category, in_hour as mode_value, count(*) as n, "
    "row_number() over (partition by location_category order by count(*) desc, in_hour) as r from "
    "(select location_category, cast(hour(in_dttm) as int) as in_hour from adt where in_dttm is not null) h "
    "group by 1, 2) c where r = 1",
)
def _(spark, sf):
    adt = spark_view(spark, sf, "adt").withColumn("in_hour", F.hour("in_dttm"))
    return summaries.mode_value(adt, "in_hour", ["location_category"])


# Models ---------------------------------------------------------------------

TIDY = ["estimate", "std_error", "conf_low", "conf_high"]


def _tidy_plain(df: DataFrame) -> DataFrame:
    return df.select(
        "term", "estimate", F.col("`std.error`").alias("std_error"), F.col("`conf.low`").alias("conf_low"),
        F.col("`conf.high`").alias("conf_high"), "outcome", "model_n",
    )


_LEVEL = """(select {x} as x, count(*) filter (where {y} = 1) as a, count(*) filter (where {y} = 0) as b
from {t} where {x} is not null and {y} is not null group by 1)"""


def saturated_sql(table: str, outcome: str, x: str, numeric: bool) -> str:
    """Closed form of a one-factor logistic model: the first level is the reference."""
    term = f"'{x}'" if numeric else f"concat('{x}', g.x)"
    levels = _LEVEL.format(x=x, y=outcome, t=table)
    z = "1.959963984540054"
    return f"""with lv as {levels}, r as (select * from lv where x = (select min(x) from lv)),
g as (select lv.x, ln(lv.a * r.b::double / (lv.b * r.a)) as beta, sqrt(1.0/lv.a + 1.0/lv.b + 1.0/r.a + 1.0/r.b) as se
  from lv, r where lv.x <> r.x),
t as (select {term} as term, beta, se from g union all select '(Intercept)', ln(a::double / b), sqrt(1.0/a + 1.0/b) from r)
select term, exp(beta) as estimate, se as std_error, exp(beta - {z} * se) as conf_low, exp(beta + {z} * se) as conf_high,
  '{outcome}' as outcome, (select cast(sum(a + b) as bigint) from lv) as model_n from t"""


@register("logistic_model_two_by_two", saturated_sql("ana", "hospital_mortality", "phenotype_primary", True), TIDY)
def _(spark, sf):
    fit = models.fit_logistic(analysis_table(spark, sf), "hospital_mortality", ["phenotype_primary"])
    return _tidy_plain(models.tidy(spark, [(fit, "hospital_mortality", "phenotype_primary")], [True]))


@register("logistic_model_factor", saturated_sql("ana", "any_crrt", "cancer_type_broad", False), TIDY)
def _(spark, sf):
    fit = models.fit_logistic(analysis_table(spark, sf), "any_crrt", [], ["cancer_type_broad"])
    return _tidy_plain(models.tidy(spark, [(fit, "any_crrt", "cancer_type_broad")], [True]))


@register("logistic_model")
def _(spark, sf):
    fit = outcome_models.logistic_model(analysis_table(spark, sf), "hospital_mortality", ci="profile")
    return models.tidy(spark, [(fit, "hospital_mortality", outcome_models.EXPOSURE)], [True])


@register(
    "linear_model_one_regressor",
    """with s as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy,
  regr_sxy(y, x) as sxy, regr_avgx(y, x) as mx, count(*) as n
  from (select hospital_los_days as y, cast(age_at_admission as double) as x from ana) d),
v as (select *, (syy - sxy * sxy / sxx) / (n - 2) as s2 from s)
select '(Intercept)' as term, a as estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) as std_error, n as model_n from v
union all select 'age_at_admission', b, sqrt(s2 / sxx), n from v""",
    ["estimate", "std_error"],
)
def _(spark, sf):
    fit = models.fit_linear(analysis_table(spark, sf), "hospital_los_days", ["age_at_admission"])
    out = models.tidy(spark, [(fit, "hospital_los_days", "age_at_admission")], [False])
    return out.select("term", "estimate", F.col("`std.error`").alias("std_error"), "model_n")


def adjusted_sql(outcome: str, logistic: bool, steps: int = 12) -> str:
    """The study's adjusted model in SQL: normal equations as lists, solved pivot by pivot; Newton steps if logistic.

    Gives estimates and standard errors. Age and year are centred, which the intercept's row undoes.
    """
    numeric, centers = outcome_models.NUMERIC, [0, 60, 1996]
    factors = outcome_models.FACTORS
    pivot = "cast(q[1][1] as int)"
    cleared = (
        f"list_transform(range(1, len(m) + 1), lambda i: case when i = {pivot} then list_transform(m[{pivot}], lambda v: v / m[{pivot}][{pivot}]) "
        f"else list_transform(range(1, len(m[i]) + 1), lambda j: m[i][j] - m[i][{pivot}] * m[{pivot}][j] / m[{pivot}][{pivot}]) end)"
    )

    def solved(matrix: str) -> str:
        """Gauss-Jordan on a list of rows; what stands right of the square part is the solution."""
        return f"list_reduce(list_prepend({matrix}, list_transform(range(1, len({matrix}) + 1), lambda k: [[cast(k as double)]])), lambda m, q: {cleared})"

    def square(weights: str, score: str, source: str) -> str:
        """(m): the information matrix with the score as a last column."""
        return (
            f"select list(row order by i) as m from (select i, list_append(list(v order by j), max(g)) as row from (select i, j, sum({weights} * x[i] * x[j]) as v, "
            f"sum({score} * x[i]) as g from {source}, places p1(i), places p2(j) group by i, j) e group by i) r"
        )

    levels = ", ".join(f"(select list(distinct {f} order by {f})[2:] from d) as l{k}" for k, f in enumerate(factors))
    dummies = ", ".join(f"list_transform(l{k}, lambda v: cast({f} = v as double))" for k, f in enumerate(factors))
    names = ", ".join(f"list_transform(l{k}, lambda v: '{f}' || v)" for k, f in enumerate(factors))
    whole = "'(Intercept)', " + ", ".join(f"'{c}'" for c in numeric)
    xs = "cast(1 as double), " + ", ".join(f"cast({c} - {m} as double)" for c, m in zip(numeric, centers, strict=True))
    ctes = [
        f"d as materialized (select cast({outcome} as double) as y, cast(probable_checkpoint_irae_icu = 1 as int) as {outcome_models.EXPOSURE}, age_at_admission, icu_year, "
        + ", ".join(f"coalesce({f}, 'missing') as {f}" for f in factors)
        + f" from ana where {outcome} is not null and probable_checkpoint_irae_icu is not null and age_at_admission is not null and icu_year is not null)",
        f"l as materialized (select {levels})",
        f"pat as materialized (select x, cast(count(*) as double) as n, sum(y) as s, sum(y * y) as ss from (select y, flatten([[{xs}], {dummies}]) as x from d, l) r group by x)",
        "places as materialized (select unnest(range(1, (select len(x) from pat limit 1) + 1)) as i)",
    ]
    if logistic:
        ctes.append("b0 as materialized (select list_transform(x, lambda v: cast(0 as double)) as b from pat limit 1)")
        for k in range(steps + 1):
            ctes.append(f"e{k} as materialized (select x, n, s, 1 / (1 + exp(-list_inner_product(x, b))) as p from pat, b{k})")
            ctes.append(f"h{k} as materialized ({square('n * p * (1 - p)', '(s - n * p)', f'e{k}')})")
            if k < steps:
                ctes.append(f"v{k} as materialized (select {solved('m')} as m from h{k})")
                ctes.append(f"b{k + 1} as materialized (select list_transform(range(1, len(b) + 1), lambda i: b[i] + m[i][-1]) as b from b{k}, v{k})")
        last, scale = f"b{steps}", "select cast(1 as double) as s2"
        matrix = f"h{steps}"
    else:
        ctes.append(f"h as materialized ({square('n', 's', 'pat')})")
        ctes.append(f"v as materialized (select {solved('m')} as m from h)")
        ctes.append("b as materialized (select list_transform(m, lambda r: r[-1]) as b from v)")
        last, matrix = "b", "h"
        scale = "select sum(ss - 2 * s * list_inner_product(x, b) + n * list_inner_product(x, b) ** 2) / (sum(n) - max(len(x))) as s2 from pat, b"
    identity = "list_transform(range(1, len(m) + 1), lambda i: list_concat(m[i][:-2], list_transform(range(1, len(m) + 1), lambda j: cast(i = j as double))))"
    ctes += [
        f"w as materialized (select {identity} as m from {matrix})",
        f"inverse as materialized (select list_transform({solved('m')}, lambda r: r[len(r) // 2 + 1:]) as c from w)",
        f"scale as ({scale})",
        f"names as (select flatten([[{whole}], {names}]) as t from l)",
        f"shift as (select [1, {', '.join(str(-m) for m in centers)}] as a)",
    ]
    back = f"range(1, {len(centers) + 2})"
    estimate = f"case when i = 1 then list_sum(list_transform({back}, lambda k: a[k] * b[k])) else b[i] end"
    variance = f"case when i = 1 then list_sum(flatten(list_transform({back}, lambda k: list_transform({back}, lambda h: a[k] * a[h] * c[k][h])))) else c[i][i] end"
    return (
        f"with {', '.join(ctes)} select t[i] as term, {estimate} as estimate, sqrt(s2 * {variance}) as std_error, (select count(*) from d) as model_n "
        f"from places, {last}, inverse, scale, names, shift"
    )


def _adjusted(outcome: str, logistic: bool) -> None:
    @register(f"adjusted_{outcome}", adjusted_sql(outcome, logistic), ["estimate", "std_error"])
    def _(spark, sf):
        """Estimates and standard errors of an adjusted model, which its limits and p-values rest on."""
        data = analysis_table(spark, sf)
        fit = outcome_models.logistic_model(data, outcome, ci="wald") if logistic else outcome_models.linear_model(data, outcome)
        out = models.tidy(spark, [(fit, outcome, outcome_models.EXPOSURE)], [False])
        return out.select("term", "estimate", F.col("`std.error`").alias("std_error"), "model_n")


for _outcome in outcome_models.LOGISTIC_OUTCOMES:
    _adjusted(_outcome, True)
for _outcome in outcome_models.LINEAR_OUTCOMES:
    _adjusted(_outcome, False)


@register("linear_model")
def _(spark, sf):
    fit = outcome_models.linear_model(analysis_table(spark, sf), "icu_los_days")
    return models.tidy(spark, [(fit, "icu_los_days", outcome_models.EXPOSURE)], [False])


@register("model_results")
def _(spark, sf):
    return outcome_models.model_results(outcome_models.all_models(stored_analysis(spark, sf)))


@register("model_results_all_terms")
def _(spark, sf):
    return outcome_models.all_models(stored_analysis(spark, sf))


@register(
    "factor_missing_level",
    "select coalesce(admission_type_category, 'missing') as admission_type_category, coalesce(cancer_type_broad, 'missing') "
    "as cancer_type_broad, count(*) as n from ana group by 1, 2",
)
def _(spark, sf):
    data = outcome_models.model_data(analysis_table(spark, sf))
    return counted(data.select("admission_type_category", "cancer_type_broad"))


@register("trend_model")
def _(spark, sf):
    fit = outcome_models.trend_model(analysis_table(spark, sf))
    return models.tidy(spark, [(fit, "probable_checkpoint_irae_icu", "icu_year")], [True])


# Exposure -------------------------------------------------------------------

_LINKED = ["hospitalization_id", "county_code", "icu_year", "pm25_annual", "pm25_filled_2024", "no2_annual",
           "svi_year_release", "svi_overall", "svi_theme1", "svi_theme2", "svi_theme3", "svi_theme4"]
_LINKED_F = ["pm25_annual", "no2_annual", "svi_overall", "svi_theme1", "svi_theme2", "svi_theme3", "svi_theme4"]


@register("exposome_link", f"select {', '.join(_LINKED)} from linked", _LINKED_F)
def _(spark, sf):
    data = analysis_table(spark, sf)
    return exposure.exposome_link(data, *panels(spark, sf), max_year=MAX_YEAR, strict=True).select(*_LINKED)


@register("exposure_quartiles", "select hospitalization_id, pm25_q, no2_q, svi_q from expo")
def _(spark, sf):
    return with_quartiles(spark, sf).select("hospitalization_id", "pm25_q", "no2_q", "svi_q")


@register(
    "ntile_quartile",
    "select o_orderkey, case when o_totalprice is not null then cast(ntile(4) over (order by o_totalprice, o_orderkey) as int) "
    "end as price_q, cast(ntile(10) over (order by cast(year(o_orderdate) as double), o_orderkey) as int) as year_decile from orders",
)
def _(spark, sf):
    orders = source(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    quarters = quantiles.add_ntiles(orders, {"price_q": "o_totalprice"}, "o_orderkey", 4)
    return quantiles.add_ntiles(quarters, {"year_decile": "y"}, "o_orderkey", 10).select(
        "o_orderkey", "price_q", "year_decile"
    )


@register(
    "ntile_quartile_text",
    "select 'S' || o_orderkey as order_ref, cast(ntile(4) over (order by o_totalprice, 'S' || o_orderkey) as int) as price_q, "
    "cast(ntile(10) over (order by cast(year(o_orderdate) as double), 'S' || o_orderkey) as int) as year_decile from orders",
)
def _(spark, sf):
    """Tiles with text ids, whose true order breaks the ties."""
    orders = source(spark, sf, "orders").select(F.concat(F.lit("S"), "o_orderkey").alias("order_ref"), "o_totalprice", F.year("o_orderdate").alias("y"))
    quarters = quantiles.add_ntiles(orders, {"price_q": "o_totalprice"}, "order_ref", 4)
    return quantiles.add_ntiles(quarters, {"year_decile": "y"}, "order_ref", 10).select("order_ref", "price_q", "year_decile")


def _from_linked(name: str, fn, sql: str, floats: list[str] | None = None, quartiles: bool = True):
    @register(name, sql, floats)
    def _(spark, sf):
        return fn((with_quartiles if quartiles else linked)(spark, sf))


_from_linked(
    "linkage_qc", exposure.linkage_qc,
    "select count(*) as n_total, count(*) filter (where county_code is null or county_code = '') as n_county_missing, "
    "count(pm25_annual) as n_pm25_linked, count(no2_annual) as n_no2_linked, count(svi_overall) as n_svi_linked, "
    "count(*) filter (where pm25_filled_2024) as n_pm25_filled_2024 from linked", quartiles=False,
)
_from_linked(
    "yearly_exposure_summary", exposure.yearly_exposure_summary,
    "select icu_year, count(*) as n, avg(phenotype_primary) as phenotype_rate, avg(hospital_mortality) as mortality_rate, "
    "avg(pm25_annual) as pm25_mean, avg(no2_annual) as no2_mean, avg(svi_overall) as svi_mean, avg(svi_theme3) as "
    "svi_theme3_mean from linked group by 1",
    ["phenotype_rate", "mortality_rate", "pm25_mean", "no2_mean", "svi_mean", "svi_theme3_mean"], quartiles=False,
)
_YR = ["rate", "se", "rate_low", "rate_high"]
_from_linked("yearly_burden", exposure.yearly_burden, "select * from year_rate", [*_YR, "pm25_mean"], quartiles=False)
_from_linked(
    "trend_lines", lambda d: exposure.trend_lines(exposure.yearly_burden(d)),
    "select icu_year, 'ICI irAE burden' as series, rate as value from year_rate union all select icu_year, "
    "'Cancer ICU volume', n / (select case when max(rate) > 0 then max(n) / max(rate) else 1 end from year_rate) from year_rate",
    ["value"], quartiles=False,
)


def _quartile_sql(event: str, where: str) -> str:
    parts = [
        f"select {q} as exposure_group, '{label}' as pollutant, count(*) as n, "
        f"coalesce(cast(sum({event}) as bigint), 0) as events from expo where {q} is not null and {where} group by 1"
        for q, label in (("pm25_q", "PM2.5"), ("no2_q", "NO2"))
    ]
    return f"select *, {o.RATE.format(e='events', n='n')} from ({' union all '.join(parts)}) c"


_from_linked("quartile_phenotype", exposure.quartile_phenotype, _quartile_sql("phenotype_primary", "true"), _YR)
_from_linked("quartile_mortality", exposure.quartile_mortality,
             _quartile_sql("hospital_mortality", "phenotype_primary = 1"), _YR)


@register("probable_yll", "select hospitalization_id, yll_if_death, pm25_q from prob", ["yll_if_death"])
def _(spark, sf):
    return exposure.probable_yll(with_quartiles(spark, sf)).select("hospitalization_id", "yll_if_death", "pm25_q")


@register("pm25_reference", "select * from ref", ["ref"])
def _(spark, sf):
    return exposure.pm25_reference(probable(spark, sf))


_Q_F = ["total_yll_observed", "mean_yll_per_case", "mean_yll_per_death", "baseline_yll_per_case_q1",
        "baseline_total_yll_q1_rate", "excess_yll_per_case_vs_q1", "excess_total_yll_vs_q1", "observed_minus_excess"]


@register("pm25_yll_quartiles", "select * from q_full", _Q_F)
def _(spark, sf):
    return exposure.pm25_yll_quartiles(exposure.probable_yll(with_quartiles(spark, sf)))


@register(
    "pm25_yll_decomposition",
    "select pm25_q, 'Baseline YLL at Q1 rate' as component, baseline_total_yll_q1_rate as yll from q_full "
    "union all select pm25_q, 'Excess YLL above Q1', excess_total_yll_vs_q1 from q_full",
    ["yll"],
)
def _(spark, sf):
    quartiles = exposure.pm25_yll_quartiles(exposure.probable_yll(with_quartiles(spark, sf)))
    return exposure.pm25_yll_decomposition(quartiles)


def newton_sql(outcome: str, x: str, table: str, center: int, steps: int = 12) -> str:
    """A logistic model of one regressor, fitted in SQL by Newton steps on the counts of each value."""
    p = "(1 / (1 + exp(-(a + b * x))))"
    sums = (
        f"sum(e - n * {p}) as g0, sum(x * (e - n * {p})) as g1, sum(n * {p} * (1 - {p})) as h00, "
        f"sum(x * n * {p} * (1 - {p})) as h01, sum(x * x * n * {p} * (1 - {p})) as h11"
    )
    ctes = [
        f"y as (select cast({x} - {center} as double) as x, cast(sum({outcome}) as double) as e, cast(count(*) as double) as n "
        f"from {table} where {x} is not null and {outcome} is not null group by 1)",
        "b0 as (select cast(0 as double) as a, cast(0 as double) as b)",
    ]
    for k in range(steps):
        ctes.append(f"s{k} as (select a, b, {sums} from y, b{k} group by a, b)")
        ctes.append(
            f"b{k + 1} as (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, "
            f"b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from s{k})"
        )
    ctes.append(f"s as (select a, b, {sums} from y, b{steps} group by a, b)")
    ctes.append(
        f"t as (select '(Intercept)' as term, a - b * {center} as beta, "
        f"sqrt((h11 + 2 * {center} * h01 + {center}.0 * {center} * h00) / (h00 * h11 - h01 * h01)) as se from s "
        f"union all select '{x}', b, sqrt(h00 / (h00 * h11 - h01 * h01)) from s)"
    )
    z = "1.959963984540054"
    return (
        f"with {', '.join(ctes)} select term, beta as estimate, se as std_error, beta - {z} * se as conf_low, beta + {z} * se as conf_high, "
        "(select cast(sum(n) as bigint) from y) as model_n from t"
    )


@register("trend_model_wald", newton_sql("probable_checkpoint_irae_icu", "icu_year", "ana", 1996), ["estimate", "std_error", "conf_low", "conf_high"])
def _(spark, sf):
    """The calendar-year model on the log-odds scale, checked against Newton steps in SQL."""
    data = outcome_models.model_data(analysis_table(spark, sf))
    fit = models.fit_logistic(data, "probable_checkpoint_irae_icu", ["icu_year"])
    rows = models.tidy(spark, [(fit, "probable_checkpoint_irae_icu", "icu_year")], [False])
    return _tidy_plain(rows).drop("outcome")


@register(
    "pm25_baseline_yll_yearly",
    "select icu_year, count(*) as n_probable_cases, coalesce(sum(case when hospital_mortality = 1 then yll_if_death when "
    "hospital_mortality = 0 then 0 end), 0) as observed_yll, count(*) * (select max(baseline_yll_per_case_q1) from q_rate) as "
    "baseline_yll from prob where pm25_annual is not null group by 1",
    ["observed_yll", "baseline_yll"],
)
def _(spark, sf):
    cases = probable(spark, sf)
    return exposure.pm25_baseline_yll_yearly(cases, exposure.pm25_yll_quartiles(cases))


@register("pollution_models")
def _(spark, sf):
    return exposure.pollution_models(stored_quartiles(spark, sf))


@register("forest_table")
def _(spark, sf):
    return exposure.forest_table(exposure.pollution_models(stored_quartiles(spark, sf)))


@register("attributable_yll_patient")
def _(spark, sf):
    return exposure.attributable_yll_patient(probable(spark, sf))


@register("attributable_yll_yearly")
def _(spark, sf):
    return exposure.attributable_yll_yearly(exposure.attributable_yll_patient(probable(spark, sf)))


@register("attributable_yll_summary")
def _(spark, sf):
    return exposure.attributable_yll_summary(exposure.attributable_yll_patient(probable(spark, sf)))


@register("pm25_yll_yearly")
def _(spark, sf):
    cases = probable(spark, sf)
    baseline = exposure.pm25_baseline_yll_yearly(cases, exposure.pm25_yll_quartiles(cases))
    return exposure.pm25_yll_yearly(
        baseline, exposure.attributable_yll_yearly(exposure.attributable_yll_patient(cases))
    )


# Notes ----------------------------------------------------------------------


def _pattern(group: str, domain: str) -> str | None:
    return lookups.concept_patterns(CONCEPTS, domain).get(group)


def notes_sql() -> dict[str, str]:
    """CTEs ``nl`` (note level) and ``el`` (encounter level)."""
    groups = lookups.concept_groups(CONCEPTS)
    parts = []
    for kind, domain, where in (("handp", "all", "true"), ("radiology", "radiology", CHEST_SQL)):
        columns = []
        for g in groups:
            p = _pattern(g, domain)
            if p is None:
                columns += [f"0 as any_{g}", f"cast(null as varchar) as snippet_{g}"]
            else:
                columns.append(f"cast(regexp_matches(txt, '(?i){p}') as int) as any_{g}")
                columns.append(f"{snippet_sql('NOTE_TEXT', p, 'raw')} as snippet_{g}")
        parts.append(
            f"select MRN, HAR, NOTE_ID, PROC_NAME, NOTE_TEXT, '{kind}' as note_source, {NOTE_TIME_SQL} as note_datetime, "
            + ", ".join(columns)
            + f" from (select *, {letters_sql(o.norm('NOTE_TEXT'))} as txt, {letters_sql('NOTE_TEXT')} as raw from notes "
            f"where note_kind = '{kind}' and {where}) s"
        )
    score = " + ".join(f"{w} * any_{g}" for g, w in note_review.SCORE_WEIGHTS.items())
    ici = " or ".join(f"any_{g} = 1" for g in note_review.ICI_GROUPS)
    irae = " or ".join(f"any_{g} = 1" for g in note_review.IRAE_GROUPS)
    level = (
        "select *, cast(rule_score >= 3 or (candidate_ici_exposure_note = 1 and candidate_irae_note = 1) or (note_source = "
        "'radiology' and any_radiology_supportive_pneumonitis = 1) as int) as llm_priority_note from (select *, "
        f"{score} as rule_score, cast({ici} as int) as candidate_ici_exposure_note, cast({irae} as int) as candidate_irae_note "
        f"from ({' union all '.join(parts)}) u) w"
    )
    first = {
        "example_ici_snippet": note_review.ICI_GROUPS,
        "example_irae_snippet": note_review.IRAE_GROUPS,
        "example_competing_snippet": note_review.COMPETING_GROUPS,
    }
    order = "order by note_source, note_datetime nulls last, NOTE_ID"
    examples = ", ".join(
        "coalesce(" + ", ".join(f"first(snippet_{g} {order}) filter (where snippet_{g} <> '')" for g in gs) + f") as {name}"
        for name, gs in first.items()
    )
    flags = ", ".join(f"max({src}) as {name}" for name, src in note_review.ENCOUNTER_FLAGS.items())
    enc = (
        "select *, cast(encounter_rule_label in ('high_priority_ici_irae_review', 'moderate_priority_possible_ici_irae') as int) "
        "as encounter_llm_priority from (select *, case when encounter_any_ici_exposure = 1 and (encounter_any_irae_signal = 1 or "
        "encounter_radiology_supportive = 1) then 'high_priority_ici_irae_review' when encounter_any_irae_signal = 1 or "
        "(encounter_any_ici_exposure = 1 and (encounter_steroid_signal = 1 or encounter_rescue_signal = 1)) then "
        "'moderate_priority_possible_ici_irae' when encounter_competing_infection = 1 or encounter_competing_progression = 1 or "
        "encounter_competing_edema = 1 or encounter_competing_aspiration = 1 then (case when encounter_any_ici_exposure = 0 "
        "then 'competing_diagnosis_only' else 'low_signal' end) else 'low_signal' end as encounter_rule_label from "
        "(select MRN, HAR, count(*) as n_notes, cast(sum(llm_priority_note) as bigint) as n_llm_priority_notes, "
        f"min(note_datetime) as first_note_datetime, max(note_datetime) as last_note_datetime, {flags}, "
        f"max(rule_score) as max_rule_score, {examples} from nl group by 1, 2) g) l"
    )
    return {"nl": level, "el": enc}


o.CTES.update(notes_sql())
_QUEUE = [c for c in note_review.QUEUE_COLUMNS if c not in ("NOTE_CSN_ID", "NOTE_TYPE", "AUTHOR_SERV")]
_QUEUE_SQL = (
    f"select {', '.join(_QUEUE)} from (select nl.*, encounter_rule_label, row_number() over (partition by nl.MRN, nl.HAR, "
    "note_source order by rule_score desc, note_datetime nulls last, NOTE_ID) as r from nl join el on nl.MRN = el.MRN and "
    "nl.HAR = el.HAR where encounter_llm_priority = 1) k where (note_source = 'handp' and r <= 2) or "
    "(note_source = 'radiology' and r <= 3)"
)
_GROUPS = lookups.concept_groups(CONCEPTS)


@register(
    "dictionary_flags",
    "select NOTE_ID, note_source, " + ", ".join(f"any_{g}, snippet_{g}" for g in _GROUPS) + " from nl",
)
def _(spark, sf):
    return scored_notes(spark, sf).select(
        "NOTE_ID", "note_source", *[c for g in _GROUPS for c in (f"any_{g}", f"snippet_{g}")]
    )


@register(
    "concept_dictionary",
    "select NOTE_ID, note_source, " + ", ".join(f"any_{g}" for g in lookups.concept_groups(CONCEPTS)) + " from nl",
)
def _(spark, sf):
    """Concepts from a file with doubled backslashes, applied to the notes."""
    path = f"{io.shared_dir(spark)}/cohortspark/concepts-{spark.sparkContext.applicationId}-{sf.replace('/', '_')}"
    rows = [(i, *c[:3], c[3].replace("\\", "\\\\")) for i, c in enumerate(CONCEPTS)]
    columns = ["note_domain", "concept_group", "concept_name", "pattern"]
    frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in columns))
    io.write_table(frame.coalesce(1).sortWithinPartitions("i").drop("i"), path, "csv")
    read = lookups.read_concepts(spark, path)
    return scored_notes(spark, sf, read).select("NOTE_ID", "note_source", *[f"any_{g}" for g in lookups.concept_groups(read)])


_LEVEL_COLUMNS = ["MRN", "HAR", "NOTE_ID", "note_source", "note_datetime", "candidate_ici_exposure_note",
                  "candidate_irae_note", "rule_score", "llm_priority_note"]


@register("note_level", f"select {', '.join(_LEVEL_COLUMNS)} from nl where note_source = 'handp'")
def _(spark, sf):
    return note_review.note_level(note_sources(spark, sf)[0], "handp", "all", CONCEPTS).select(*_LEVEL_COLUMNS)


@register(
    "score_note",
    "select note_source, rule_score, llm_priority_note, count(*) as n from nl group by 1, 2, 3",
)
def _(spark, sf):
    return counted(scored_notes(spark, sf).select("note_source", "rule_score", "llm_priority_note"))


@register("radiology_filter", f"select count(*) as n, count(distinct MRN) as n_mrn from notes where note_kind = 'radiology' and {CHEST_SQL}")
def _(spark, sf):
    kept = note_review.radiology_filter(note_sources(spark, sf)[1])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("MRN").alias("n_mrn"))


@register("all_notes", f"select {', '.join(_LEVEL_COLUMNS)} from nl")
def _(spark, sf):
    return scored_notes(spark, sf).select(*_LEVEL_COLUMNS)


@register("encounter_level", "select * from el")
def _(spark, sf):
    return note_review.encounter_level(scored_notes(spark, sf, native=True))


@register(
    "rule_label",
    "select encounter_rule_label, encounter_llm_priority, count(*) as n from el group by 1, 2",
)
def _(spark, sf):
    return counted(
        note_review.encounter_level(scored_notes(spark, sf)).select("encounter_rule_label", "encounter_llm_priority")
    )


@register(
    "first_nonmissing",
    "select MRN, HAR, example_ici_snippet, example_irae_snippet, example_competing_snippet from el",
)
def _(spark, sf):
    return note_review.encounter_level(scored_notes(spark, sf)).select(
        "MRN", "HAR", "example_ici_snippet", "example_irae_snippet", "example_competing_snippet"
    )


@register("review_queue", _QUEUE_SQL)
def _(spark, sf):
    notes = io.materialize(scored_notes(spark, sf))
    return note_review.review_queue(notes, note_review.encounter_level(notes))


@register(
    "top_k_per_group",
    "select l_returnflag, l_linestatus, l_extendedprice, l_orderkey, cast(r as int) as rank_in_group from (select *, "
    "rank() over (partition by l_returnflag, l_linestatus order by l_extendedprice desc, l_orderkey, l_partkey) as r from "
    "lineitem) k where r <= 3",
    ["l_extendedprice"],
)
def _(spark, sf):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")]
    top = note_review.top_k_per_group(source(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], order, 3)
    return top.select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey", "rank_in_group")


@register(
    "extraction_summary",
    "select (select count(*) from nl) as n_notes_total, (select count(*) from nl where note_source = 'handp') as n_handp_notes, "
    "(select count(*) from nl where note_source = 'radiology') as n_radiology_notes, (select count(*) from el) as n_encounters, "
    "(select count(*) from el where encounter_rule_label = 'high_priority_ici_irae_review') as n_high_priority, "
    "(select count(*) from el where encounter_rule_label = 'moderate_priority_possible_ici_irae') as n_moderate_priority, "
    f"(select count(*) from ({_QUEUE_SQL}) qq) as n_llm_queue_notes",
)
def _(spark, sf):
    notes = io.materialize(scored_notes(spark, sf))
    encounters = io.materialize(note_review.encounter_level(notes))
    return note_review.extraction_summary(notes, encounters, note_review.review_queue(notes, encounters))


# Inpatient cohort, outliers, trajectories -------------------------------------

o.CTES.update(
    {
        "eligible": f"select * from hospitalization where admission_dttm between timestamp '{START}' and timestamp '{END}' "
        "and age_at_admission >= 18",
        "er_dead": "select distinct hospitalization_id from hospitalization where discharge_category = 'Expired' and "
        "hospitalization_id in (select hospitalization_id from adt group by 1 having "
        "min(cast(coalesce(location_category = 'ER', false) as int)) = 1)",
        "inpatients": "select hospitalization_id from eligible where hospitalization_id in (select hospitalization_id from adt "
        "where location_category in ('Ward', 'ICU')) union select hospitalization_id from er_dead",
    }
)


def inpatients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inpatient.inpatient_cohort(
        spark_view(spark, sf_dir, "hospitalization"), spark_view(spark, sf_dir, "adt"), START, END
    )


@register("inpatient_cohort", "select * from inpatients")
def _(spark, sf):
    return inpatients(spark, sf)


@register("er_death_ids", "select * from er_dead")
def _(spark, sf):
    return inpatient.er_death_ids(spark_view(spark, sf, "hospitalization"), spark_view(spark, sf, "adt"))


@register("id_union", "select hospitalization_id from icu_hosp union select hospitalization_id from poa")
def _(spark, sf):
    icu = anchors.icu_anchor(spark_view(spark, sf, "adt")).select("hospitalization_id")
    return inpatient.id_union(icu, anchors.poa_cancer(spark_view(spark, sf, "hospital_diagnosis")).select("hospitalization_id"))


_FILTERED = ["hospitalization", "adt", "labs", "vitals", "respiratory_support", "medication_admin_continuous"]


@register(
    "filter_tables",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as n from {t} where hospitalization_id in (select hospitalization_id from inpatients)"
        for t in _FILTERED
    )
    + " union all select 'patient', count(*) from patient where patient_id in (select patient_id from eligible)",
)
def _(spark, sf):
    hosp = spark_view(spark, sf, "hospitalization")
    ids = io.materialize(inpatients(spark, sf))
    tables = {name: spark_view(spark, sf, name) for name in [*_FILTERED, "patient"]}
    kept = inpatient.filter_tables(tables, ids, inpatient.eligible_admissions(hosp, START, END))
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, df in kept.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@register(
    "admits_per_patient",
    "select patient_id, count(*) as n_hospitalizations from hospitalization where hospitalization_id in "
    "(select hospitalization_id from inpatients) group by 1",
)
def _(spark, sf):
    return inpatient.admits_per_patient(
        inpatient.semi_filter(spark_view(spark, sf, "hospitalization"), inpatients(spark, sf))
    )


def describe_sql(table: str, categories: list[str], numbers: list[str], by: str | None = None) -> str:
    b, same = (f"{by}, ", f"x.{by} is not distinct from y.{by} and ") if by else ("", "")
    xb = f"x.{by}, " if by else ""
    group = f"group by {by}" if by else ""
    parts = [
        f"select {xb}'{c}' as variable, x.level, x.n, case when x.level is not null then 100.0::double * x.n / y.m end as pct, "
        "cast(null as double) as median, cast(null as double) as p25, cast(null as double) as p75 from "
        f"(select {b}{c} as level, count(*) as n from {table} group by all) x left join "
        f"(select {b}count({c}) as m from {table} {group}) y on {same}true"
        for c in categories
    ]
    parts += [
        f"select {b}'{v}' as variable, cast(null as varchar) as level, count({v}) as n, cast(null as double) as pct, "
        f"quantile_cont(cast({v} as double), 0.5) as median, quantile_cont(cast({v} as double), 0.25) as p25, "
        f"quantile_cont(cast({v} as double), 0.75) as p75 from {table} {group}"
        for v in numbers
    ]
    return " union all ".join(parts)


o.CTES.update(
    {
        "t1p": f"""select p.*, date_diff('day', cast(birth_date as date), date '{START}') / 365.25::double as age, n_hospitalizations
from (select * from patient where patient_id in (select patient_id from eligible)) p left join (select patient_id, count(*) as
n_hospitalizations from hospitalization where hospitalization_id in (select hospitalization_id from inpatients) group by 1) a
using (patient_id)""",
        "t1h": """select h.*, date_diff('day', cast(admission_dttm as date), cast(discharge_dttm as date)) as length_of_stay,
  race_category, sex_category, ethnicity_category, language_name,
  case when hospitalization_id in (select hospitalization_id from adt where location_category = 'ICU') then 1 else 0 end as ever_icu
from (select * from hospitalization where hospitalization_id in (select hospitalization_id from inpatients)) h
left join (select * from patient where patient_id in (select patient_id from eligible)) p using (patient_id)""",
    }
)


def cohort_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    hosp = spark_view(spark, sf_dir, "hospitalization")
    tables = {name: spark_view(spark, sf_dir, name) for name in ("hospitalization", "patient", "adt")}
    return inpatient.filter_tables(
        tables, io.materialize(inpatients(spark, sf_dir)), inpatient.eligible_admissions(hosp, START, END)
    )


_SPREAD = ["pct", "median", "p25", "p75"]


@register("table_one_patient", describe_sql("t1p", inpatient.PATIENT_CATEGORIES, inpatient.PATIENT_NUMBERS), _SPREAD)
def _(spark, sf):
    kept = cohort_frames(spark, sf)
    return inpatient.table_one_patient(kept["patient"], kept["hospitalization"], START)


@register(
    "table_one_hospitalization",
    describe_sql("t1h", inpatient.STAY_CATEGORIES, inpatient.STAY_NUMBERS, "ever_icu"), _SPREAD,
)
def _(spark, sf):
    kept = cohort_frames(spark, sf)
    return inpatient.table_one_hospitalization(kept["hospitalization"], kept["patient"], kept["adt"])


o.CTES.update(
    {
        "lab_lim": o.limits(o.LAB_LIMITS),
        "vital_lim": o.limits(o.VITAL_LIMITS),
        "lab_num": f"select hospitalization_id, lab_category, {o.num('lab_value')} as v from labs",
        "lab_cleaned": "select hospitalization_id, lab_category, case when v between lower_limit and upper_limit then v end as "
        "lab_value_numeric from lab_num left join lab_lim on lab_category = name",
        "vital_cleaned": "select hospitalization_id, vital_category, case when v between lower_limit and upper_limit then v end as "
        "vital_value from (select *, try_cast(vital_value as double) as v from vitals) n left join vital_lim on vital_category = name",
    }
)


@register(
    "replace_outliers",
    counted_sql("select lab_category, lab_value_numeric from lab_cleaned", "lab_category, lab_value_numeric"),
    ["lab_value_numeric"],
)
def _(spark, sf):
    cleaned = outliers.replace_outliers(numeric_labs(spark, sf), lab_limits(spark), "lab_category", "lab_value_numeric")
    return counted(cleaned.select("lab_category", "lab_value_numeric"))


@register(
    "replace_outliers_keep_unruled",
    counted_sql("select lab_category, case when lower_limit is null or v between lower_limit and upper_limit then v end as "
                "lab_value_numeric from lab_num left join lab_lim on lab_category = name", "lab_category, lab_value_numeric"),
    ["lab_value_numeric"],
)
def _(spark, sf):
    cleaned = outliers.replace_outliers(
        numeric_labs(spark, sf), lab_limits(spark), "lab_category", "lab_value_numeric", keep_unruled=True
    )
    return counted(cleaned.select("lab_category", "lab_value_numeric"))


def _summary_sql(table: str, category: str, value: str) -> str:
    return (
        f"select {category}, count({value}) as \"N\", min({value}) as \"Min\", max({value}) as \"Max\", avg({value}) as \"Mean\", "
        f"quantile_cont({value}, 0.5) as \"Median\", quantile_cont({value}, 0.25) as \"First_Quartile\", "
        f"quantile_cont({value}, 0.75) as \"Third_Quartile\" from {table} group by 1"
    )


_SUMMARY_F = ["\"Min\"", "\"Max\"", "\"Mean\"", "\"Median\"", "\"First_Quartile\"", "\"Third_Quartile\""]


@register("lab_summary", _summary_sql("lab_cleaned", "lab_category", "lab_value_numeric"), _SUMMARY_F)
def _(spark, sf):
    return inpatient.clean_summary(numeric_labs(spark, sf), lab_limits(spark), "lab_category", "lab_value_numeric")


@register("vital_summary", _summary_sql("vital_cleaned", "vital_category", "vital_value"), _SUMMARY_F)
def _(spark, sf):
    return inpatient.clean_summary(numeric_vitals(spark, sf), vital_limits(spark), "vital_category", "vital_value")


@register(
    "outlier_preview",
    "select lab_category, count(*) as n_rows, count(*) filter (where v is null) as n_missing, count(*) filter (where v < "
    "lower_limit) as n_below, count(*) filter (where v > upper_limit) as n_above, count(*) filter (where v between lower_limit "
    "and upper_limit) as n_in_range, count(*) filter (where lower_limit is null and v is not null) as n_no_rule from lab_num "
    "left join lab_lim on lab_category = name group by 1",
)
def _(spark, sf):
    return outliers.outlier_preview(numeric_labs(spark, sf), lab_limits(spark), "lab_category", "lab_value_numeric")


@register(
    "replace_outliers_wide",
    counted_sql("select device_category, case when f between 0.21 and 1 then f end as fio2_set from "
                "(select device_category, fio2_set / 60 as f from respiratory_support) r", "device_category, fio2_set"),
    ["fio2_set"],
)
def _(spark, sf):
    support = spark_view(spark, sf, "respiratory_support").withColumn("fio2_set", F.col("fio2_set") / 60)
    cleaned = outliers.replace_outliers_wide(support, lookups.RESPIRATORY_LIMITS)
    return counted(cleaned.select("device_category", "fio2_set"))


_HOURS = "date_diff('microsecond', in_dttm, out_dttm) / 3600e6"


@register(
    "icu_min_stay",
    f"select hospitalization_id, coalesce(sum(case when {_HOURS} > 0 then {_HOURS} end), 0) as location_hours from adt where "
    f"location_category = 'ICU' group by 1 having coalesce(sum(case when {_HOURS} > 0 then {_HOURS} end), 0) >= 24",
    ["location_hours"],
)
def _(spark, sf):
    return anchors.icu_min_stay(spark_view(spark, sf, "adt"))


@register(
    "ever_device",
    "select hospitalization_id from broad where hospitalization_id in (select hospitalization_id from respiratory_support where "
    "device_category = 'IMV') and hospitalization_id not in (select hospitalization_id from respiratory_support where "
    "device_category = 'Room Air')",
)
def _(spark, sf):
    support = spark_view(spark, sf, "respiratory_support")
    return anchors.ever_device(broad(spark, sf), support, "imv", "room air").select("hospitalization_id")


@register(
    "stitch_encounters",
    """select hospitalization_id, patient_id, cast(sum(opened) over (partition by patient_id order by admission_dttm,
  hospitalization_id rows unbounded preceding) as bigint) as episode from (select *, case when admission_dttm <= reach + interval 6 hour
  then 0 else 1 end as opened from (select *, max(discharge_dttm) over (partition by patient_id order by admission_dttm,
  hospitalization_id rows between unbounded preceding and 1 preceding) as reach from hospitalization) r) s""",
)
def _(spark, sf):
    return trajectories.stitch_encounters(spark_view(spark, sf, "hospitalization")).select(
        "hospitalization_id", "patient_id", "episode"
    )


@register(
    "waterfall_fill",
    """select user_id, event_id, last_value(purchase ignore nulls) over (partition by user_id order by ts, event_id
  rows unbounded preceding) as purchase from (select *, case when event_type = 'purchase' then value end as purchase from events) e""",
    ["purchase"],
)
def _(spark, sf):
    events = source(spark, sf, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase")
    )
    filled = trajectories.waterfall_fill(events, "user_id", "ts", ["purchase"], ["event_id"])
    return filled.select("user_id", "event_id", "purchase")


@register(
    "suppress_small_cells",
    "select age_at_admission, case when n >= 50 then n end as n, case when n >= 50 then deaths end as deaths from (select "
    "age_at_admission, count(*) as n, count(*) filter (where hospital_mortality = 1) as deaths from ana group by 1) a",
)
def _(spark, sf):
    counts = analysis_table(spark, sf).groupBy("age_at_admission").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hospital_mortality") == 1, 1)).alias("deaths")
    )
    return summaries.suppress_small_cells(counts, "n", ["deaths"], 50)
