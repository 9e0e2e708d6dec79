"""Missing-value rules shared by every operator.

Flags are integers 0/1 because they are summed. A comparison with a missing
value is unknown; aggregates ignore missing values; an "any" over nothing is 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(cond: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """0/1 flag of a condition, unknown as 0."""
    return known(cond).cast("int")


def drop_nan(col: Column) -> Column:
    """NaN to NULL, so that it neither wins a max nor passes a threshold."""
    return F.when(~F.isnan(col), col)


def any_flag(cond: Column) -> Column:
    """Aggregate: 1 if any row matches, else 0 (also for no rows)."""
    return F.coalesce(F.max(cond.cast("int")), F.lit(0))


def sum_or_zero(value: Column) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(value), F.lit(0))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def in_set(col: Column, values: Iterable) -> Column:
    """Membership that is never unknown."""
    return known(col.isin(*values))


def clip_low(col: Column, low: float) -> Column:
    """max(low, col), missing stays missing (``greatest`` would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), col))


def clip_high(col: Column, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.lit(high), col))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sorted_names(values: Column) -> Column:
    """Aggregate: distinct values in code-point order joined by `` | ``.

    The set is bounded by the vocabulary (codes, drug names), not by the rows.
    """
    return F.array_join(F.array_sort(F.collect_set(values)), " | ")


def matches(col: Column, patterns: Iterable[str]) -> Column:
    """One alternation over all patterns."""
    return col.rlike("|".join(patterns))
