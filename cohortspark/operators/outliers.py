"""Outlier limits on long and wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = "lower_limit", "upper_limit"


def parse_number(col: Column) -> Column:
    """First number in a text, commas taken as grouping marks."""
    found = F.regexp_extract(col.cast("string"), r"-?(?:\d[\d,]*(?:\.\d*)?|\.\d+)", 0)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def replace_outliers(
    df: DataFrame, limits: DataFrame, category: str, value: str, keep_unruled: bool = False
) -> DataFrame:
    """Values outside their category's limits become missing.

    A category without limits loses its values too, unless ``keep_unruled``.
    The limits come from a small fixed file, so the planner broadcasts them.
    """
    inside = F.col(value).between(F.col(LOW), F.col(HIGH))
    if keep_unruled:
        inside = inside | (F.col(LOW).isNull() & F.col(HIGH).isNull())
    return df.join(limits, category, "left").withColumn(value, F.when(inside, F.col(value))).drop(LOW, HIGH)


def replace_outliers_wide(df: DataFrame, limits: list[tuple[str, float, float]]) -> DataFrame:
    """Limits keyed by column name, applied to the columns the table has."""
    return df.withColumns(
        {
            name: F.when(F.col(name).between(low, high), F.col(name))
            for name, low, high in limits
            if name in df.columns
        }
    )


def outlier_preview(df: DataFrame, limits: DataFrame, category: str, value: str) -> DataFrame:
    """Counts per category of what the limits would do."""
    ruled = F.col(LOW).isNotNull() & F.col(HIGH).isNotNull()

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    return (
        df.join(limits, category, "left")
        .groupBy(category)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            count(F.col(value).isNull()).alias("n_missing"),
            count(F.col(value) < F.col(LOW)).alias("n_below"),
            count(F.col(value) > F.col(HIGH)).alias("n_above"),
            count(F.col(value).between(F.col(LOW), F.col(HIGH))).alias("n_in_range"),
            count(~ruled & F.col(value).isNotNull()).alias("n_no_rule"),
        )
    )
