"""Binary, continuous and categorical summary tables.

All variables of a table are summarised in one pass over the data and turned
into rows afterwards, instead of one scan per variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import count_where, ratio
from .quantiles import null_safe_join, percentile_table


def _rows(wide: DataFrame, by: list[str], variables: list[str], stats: list[str], label: str) -> DataFrame:
    """``<stat>__<variable>`` columns of each group to one row per variable."""
    entries = [
        F.struct(F.lit(v).alias(label), *[F.col(f"{s}__{v}").alias(s) for s in stats]) for v in variables
    ]
    return wide.select(*by, F.inline(F.array(*entries)))


def binary_table(
    df: DataFrame, variables: list[str], by: list[str] | None = None, label: str = "variable"
) -> DataFrame:
    """n (all rows), events (value 1) and percent per variable and group."""
    by = by or []
    aggs = [
        agg
        for v in variables
        for agg in (F.count(F.lit(1)).alias(f"n__{v}"), count_where(F.col(v) == 1).alias(f"events__{v}"))
    ]
    rows = _rows(df.groupBy(*by).agg(*aggs), by, variables, ["n", "events"], label)
    return rows.withColumn("pct", 100 * ratio(F.col("events"), F.col("n")))


def continuous_table(
    df: DataFrame, variables: list[str], by: list[str] | None = None, label: str = "variable"
) -> DataFrame:
    """n_nonmissing, mean, sd, median, quartiles, min and max per variable and group, in two passes over ``df``."""
    by = by or []
    value = F.col("value")
    moments = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")]
    table = percentile_table(df, variables, [0.25, 0.5, 0.75], by, label, moments)
    return table.select(
        *by,
        label,
        F.col("__n").alias("n_nonmissing"),
        "mean",
        "sd",
        F.col("__min").alias("min"),
        F.col("__max").alias("max"),
        F.col("p")[0].alias("p25"),
        F.col("p")[1].alias("median"),
        F.col("p")[2].alias("p75"),
    )


def category_summary(df: DataFrame, category: str, value: str) -> DataFrame:
    """N, Min, Max, Mean, Median and quartiles of a value per category."""
    table = continuous_table(df, [value], [category])
    return table.select(
        category,
        F.col("n_nonmissing").alias("N"),
        F.col("min").alias("Min"),
        F.col("max").alias("Max"),
        F.col("mean").alias("Mean"),
        F.col("median").alias("Median"),
        F.col("p25").alias("First_Quartile"),
        F.col("p75").alias("Third_Quartile"),
    )


def categorical_table(
    df: DataFrame, variables: list[str], by: list[str] | None = None, label: str = "variable"
) -> DataFrame:
    """Count and percent of each level; the percent is among non-missing values, missing is its own row."""
    by = by or []
    long = df.select(*by, *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(
        by, variables, label, "level"
    )
    levels = long.groupBy(*by, label, "level").agg(F.count(F.lit(1)).alias("n"))
    totals = (
        levels.filter(F.col("level").isNotNull()).groupBy(*by, label).agg(F.sum("n").alias("n_nonmissing"))
    )
    rows = null_safe_join(levels, totals, [*by, label], "left")
    return rows.withColumn(
        "pct", F.when(F.col("level").isNotNull(), 100 * ratio(F.col("n"), F.col("n_nonmissing")))
    ).fillna(0, subset=["n_nonmissing"])


def mode_value(df: DataFrame, variable: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent non-missing value, ties to the lowest; counted per value first."""
    by = by or []
    counts = df.filter(F.col(variable).isNotNull()).groupBy(*by, variable).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col(variable).alias("value")))
    return counts.groupBy(*by).agg(best["value"].alias("mode_value"), (-best["rank"]).alias("n"))


def suppress_small_cells(df: DataFrame, count: str, values: list[str], minimum: int = 10) -> DataFrame:
    """Blank a count below ``minimum`` and everything derived from it."""
    shown: Column = F.col(count) >= minimum
    return df.withColumns({name: F.when(shown, F.col(name)) for name in [count, *values]})
