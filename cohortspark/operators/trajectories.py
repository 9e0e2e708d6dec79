"""Per-key running values over time that stay parallel within one long key.

A plain window sorts all rows of a key in one task. Here a key's rows are cut
into calendar chunks: rows are ordered within a chunk only, one summary row per
(key, chunk) carries the running state across chunks, and both are joined. The
across-chunk window sees at most one row per calendar chunk of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import null_safe_join

_CHUNK = "__chunk"
_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, W.currentRow)


def _chunk(time: str, unit: str) -> Column:
    """Calendar chunk as a date; ``unit`` is day, week, month, quarter or year."""
    day = F.to_date(time)
    return day if unit == "day" else F.trunc(day, unit)


def _with_carry(df: DataFrame, keys: list[str], summary: DataFrame) -> DataFrame:
    return null_safe_join(df, summary, [*keys, _CHUNK], "left")


def waterfall_fill(
    df: DataFrame, key: str, time: str, columns: list[str], tiebreak: list[str], chunk: str = "day"
) -> DataFrame:
    """Carry the last known value of each column forward within a key."""
    order = [F.col(time), *[F.col(c) for c in tiebreak]]
    rows = df.withColumn(_CHUNK, _chunk(time, chunk))
    place = F.struct(time, *tiebreak)
    last = rows.groupBy(key, _CHUNK).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(place.alias("o"), F.col(c).alias("v"))))["v"].alias(f"__last_{c}")
          for c in columns]
    )
    earlier = W.partitionBy(key).orderBy(_CHUNK).rowsBetween(*_BEFORE)
    carry = last.select(
        key, _CHUNK, *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}") for c in columns]
    )
    within = W.partitionBy(key, _CHUNK).orderBy(*order).rowsBetween(*_UPTO)
    filled = rows.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(within) for c in columns})
    out = _with_carry(filled, [key], carry)
    out = out.withColumns({c: F.coalesce(f"__in_{c}", f"__carry_{c}") for c in columns})
    return out.drop(_CHUNK, *[f"__{p}_{c}" for c in columns for p in ("in", "carry")])


def stitch_encounters(
    stays: DataFrame,
    key: str = "patient_id",
    stay: str = "hospitalization_id",
    start: str = "admission_dttm",
    end: str = "discharge_dttm",
    gap_hours: int = 6,
    chunk: str = "month",
) -> DataFrame:
    """Number the episodes of a key: a stay joins the running episode if it starts
    no later than ``gap_hours`` after the latest end so far."""
    order = [F.col(start), F.col(stay)]
    rows = stays.withColumn(_CHUNK, _chunk(start, chunk))
    latest = rows.groupBy(key, _CHUNK).agg(F.max(end).alias("__end"))
    across = W.partitionBy(key).orderBy(_CHUNK).rowsBetween(*_BEFORE)
    carried_end = latest.select(key, _CHUNK, F.max("__end").over(across).alias("__carry_end"))
    inside = W.partitionBy(key, _CHUNK).orderBy(*order)
    reach: Column = F.greatest(F.max(end).over(inside.rowsBetween(*_BEFORE)), F.col("__carry_end"))
    gap = F.expr(f"INTERVAL '{gap_hours}' HOUR")
    opened = (
        _with_carry(rows, [key], carried_end)
        .withColumn("__reach", reach)
        .withColumn("__new", F.when(F.col(start) <= F.col("__reach") + gap, 0).otherwise(1))
        .drop("__carry_end", "__reach")
    )
    starts = opened.groupBy(key, _CHUNK).agg(F.sum("__new").alias("__opened"))
    carried_count = starts.select(key, _CHUNK, F.sum("__opened").over(across).alias("__carry_n"))
    numbered = _with_carry(opened, [key], carried_count)
    episode = F.sum("__new").over(inside.rowsBetween(*_UPTO)) + F.coalesce("__carry_n", F.lit(0))
    return numbered.withColumn("episode", episode).drop(_CHUNK, "__new", "__carry_n")
