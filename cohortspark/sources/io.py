"""Reading study tables, checking them, writing results, and cutting lineage."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The table names a study may switch on.
STUDY_TABLES = [
    "patient", "hospitalization", "vitals", "labs", "medication_admin_continuous", "adt",
    "patient_assessments", "respiratory_support", "position", "dialysis", "intake_output", "ecmo_mcs",
    "procedures", "admission_diagnosis", "provider", "sensitivity", "medication_orders",
    "medication_admin_intermittent", "therapy_details", "microbiology_culture", "microbiology_nonculture",
]
INPATIENT_STUDY_TABLES = [
    "patient", "hospitalization", "adt", "microbiology_culture", "vitals", "labs",
    "medication_admin_continuous", "respiratory_support",
]
REQUIRED_TABLES = ["adt", "hospitalization", "hospital_diagnosis"]
#: Rows that a bucket of a laid-out table holds, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8
#: Spark's setting that removes the shuffle files of an action as soon as it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet table, or None when the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def require_tables(tables: Mapping[str, DataFrame | None], names: Iterable[str] = REQUIRED_TABLES) -> None:
    missing = [name for name in names if tables.get(name) is None]
    if missing:
        raise ValueError("Missing required tables: " + ", ".join(missing))


def require_columns(df: DataFrame, names: Iterable[str], label: str = "table") -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{label} is missing required columns: " + ", ".join(missing))
    return df


def optional_column(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or a typed NULL when the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def ensure_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add the columns that are not there yet."""
    return df.withColumns({name: value for name, value in defaults.items() if name not in df.columns})


def read_csv_required(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; fails when the file is missing.

    A quote inside a quoted text is doubled, a backslash is an ordinary sign, and
    an empty text is missing.
    Without a schema every column is read as text (no inference pass, leading
    zeros stay). A file with quoted line breaks, as notes have them, cannot be
    split: convert large ones to Parquet once, or say ``multi_line=False`` for
    files known to have none.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    return reader.csv(path)


def read_any(
    spark: SparkSession, path: str, file_type: str, schema: StructType | str | None = None
) -> DataFrame:
    if file_type == "csv":
        return read_csv_required(spark, path, schema)
    if file_type == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type {file_type!r}: use 'csv' or 'parquet'.")


def load_study_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str] = INPATIENT_STUDY_TABLES,
    file_type: str = "parquet",
    prefix: str = "",
) -> dict[str, DataFrame]:
    """Lazy frames of the named tables; all missing names are reported together."""
    tables, missing = {}, []
    for name in names:
        try:
            tables[name] = read_any(spark, f"{directory}/{prefix}{name}.{file_type}", file_type)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    if missing:
        raise ValueError("Missing required tables: " + ", ".join(missing))
    return tables


def write_table(df: DataFrame, path: str, file_type: str = "parquet", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if file_type == "csv":
        # Quotes are doubled, blanks at the ends stay.
        writer.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    elif file_type == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"Unsupported file type {file_type!r}: use 'csv' or 'parquet'.")
    return path


def save_cohort_tables(tables: Mapping[str, DataFrame], directory: str) -> dict[str, str]:
    """One Parquet table per frame, named ``<name>_cohort``."""
    return {name: write_table(df, f"{directory}/{name}_cohort") for name, df in tables.items()}


def bucket_count(tables: Iterable[DataFrame], rows: int = BUCKET_ROWS) -> int:
    """Buckets for tables laid out together, so that none holds more than about ``rows`` rows of the largest."""
    return max(LEAST_BUCKETS, *[-(-df.count() // rows) for df in tables])


def save_laid_out(tables: Mapping[str, DataFrame], directory: str, key: str = "hospitalization_id", buckets: int = 64) -> dict[str, DataFrame]:
    """The tables written in buckets of the key, sorted within, and opened again as tables that know so.

    Joins on the key and aggregates by it then need no exchange, in this session and, through ``open_laid_out``, in
    later ones. A key lies in one bucket as a whole: choose it so that none is very frequent.
    ``bucket_count`` gives a number that grows with the tables, so that a bucket does not.
    """
    opened = {}
    for name, df in tables.items():
        df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option(
            "path", f"{directory}/{name}_cohort"
        ).saveAsTable(_laid_out_name(directory, name))
        opened[name] = df.sparkSession.table(_laid_out_name(directory, name))
    return opened


def open_laid_out(spark: SparkSession, directory: str, names: Iterable[str], key: str = "hospitalization_id", buckets: int = 64) -> dict[str, DataFrame]:
    """Tables that ``save_laid_out`` wrote with the same key and number of buckets, perhaps in another session."""
    opened = {}
    for name in names:
        path, table = f"{directory}/{name}_cohort", _laid_out_name(directory, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"create table if not exists {table} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'"
        )
        opened[name] = spark.table(table)
    return opened


def _laid_out_name(directory: str, name: str) -> str:
    return f"{name}_cohort_{zlib.crc32(directory.encode()):08x}"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A private one is made only in local mode, where every task sees it.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortspark-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read, and read it back.

    This cuts lineage, survives lost executors, keeps column pruning and filter
    pushdown for the readers, and gives the join planner the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortspark/{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_settings(path: str, required: bool = True) -> dict:
    """JSON settings file as a dict; ``tables_path`` also serves as ``tables_dir``."""
    if not os.path.exists(path):
        if required:
            raise FileNotFoundError(path)
        return {}
    with open(path, encoding="utf-8") as handle:
        settings = json.load(handle)
    if settings.get("tables_dir") is None and settings.get("tables_path") is not None:
        settings["tables_dir"] = settings["tables_path"]
    return settings


def setting(settings: Mapping, key: str, default=None, required: bool = False):
    value = settings.get(key)
    if value is None or value == "":
        if required:
            raise KeyError(f"Missing required setting: {key}")
        return default
    return value
