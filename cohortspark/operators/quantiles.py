"""Exact order statistics, percentiles and n-tiles without a single-task sort.

Built-in exact percentiles keep every distinct value of a group in one task,
and an unpartitioned ``ntile`` sorts the whole table in one task. Here a
mergeable sketch first brackets each wanted rank between two values; rows are
then counted per distinct value inside the bracket and as one number below it,
and only the bracket's distinct values (a few cells of the sketch's grid) are
ordered. The sketch decides how much is ordered, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import drop_nan
from ..sources.io import materialize

CELLS = 128  # grid of the sketch; a bracket spans three cells
ACCURACY = 16 * CELLS  # sketch error of at most 1/16 cell
FINE = 20_000  # accuracy of the sketch that brackets percentiles


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def order_statistics(
    rows: DataFrame,
    keys: list[str],
    value: str,
    targets: Callable[[Column], Column],
) -> DataFrame:
    """Values at wanted ranks of each group of a numeric column.

    ``targets`` maps the group's count of non-missing values to an array of
    structs with a 0-based ``rank`` and any further fields. Returns the keys,
    the struct fields, the value, its ``offset`` (the rank counted within the
    rows of that value) and ``ties`` (the number of those rows). The brackets,
    a few numbers per group, are stored, so that the planner knows their size.
    """
    v, n = F.col(value), F.col("__n")
    sketch = (
        rows.groupBy(*keys)
        .agg(
            F.count(v).alias("__n"),
            F.min(v).alias("__min"),
            F.max(v).alias("__max"),
            F.percentile_approx(v, [i / CELLS for i in range(1, CELLS)], ACCURACY).alias("__grid"),
        )
        .filter(n > 0)
    )
    exact_type = isinstance(rows.schema[value].dataType, T.IntegralType)

    def widen(bound: Column, side: int) -> Column:
        # The sketch computes in double; large integers lose their last bits there.
        if not exact_type:
            return bound
        slack = (F.abs(bound.cast("double")) / F.lit(2.0**51)).cast("bigint") + 1
        return F.try_add(bound, slack) if side > 0 else F.try_subtract(bound, slack)

    def bracket(target: Column) -> Column:
        cell = F.floor(target["rank"] / n * CELLS).cast("int")
        low = F.when(cell >= 2, widen(F.get("__grid", cell - 2), -1))
        high = F.when(cell <= CELLS - 3, widen(F.get("__grid", cell + 1), 1))
        return F.struct(
            target.alias("t"),
            F.coalesce(low, "__min").alias("low"),
            F.coalesce(high, "__max").alias("high"),
        )

    brackets = materialize(sketch.select(*keys, F.transform(targets(n), bracket).alias("__brackets")))
    inside = null_safe_join(rows.filter(v.isNotNull()), brackets, keys).select(
        *keys, value, F.inline("__brackets")
    )
    counts = (
        inside.filter(v <= F.col("high"))
        .groupBy(*keys, "t", F.when(v >= F.col("low"), v).alias("__v"))
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    upto = W.partitionBy(*keys, "t").orderBy(F.asc_nulls_first("__v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rank, end = F.col("t")["rank"], F.col("__end")
    found = F.coalesce(F.col("__v"), F.raise_error(F.lit("rank below its bracket")).cast(rows.schema[value].dataType))
    return (
        counts.withColumn("__end", F.sum("ties").over(upto))
        .filter((rank < end) & (rank >= end - F.col("ties")))
        .select(*keys, "t.*", found.alias(value), (rank - (end - F.col("ties"))).alias("offset"), "ties")
    )


def long_numbers(df: DataFrame, variables: list[str], by: list[str], label: str) -> DataFrame:
    """(by, variable, value) rows of several numeric columns, missing values included; NaN is missing."""
    numbers = df.select(*by, *[drop_nan(F.col(v).cast("double")).alias(v) for v in variables])
    return numbers.unpivot(by, variables, label, "value")


def percentile_table(
    df: DataFrame,
    variables: list[str],
    probs: list[float],
    by: list[str] | None = None,
    label: str = "variable",
    further: list[Column] | None = None,
) -> DataFrame:
    """Count, least and greatest value and interpolated (type 7) percentiles ``p[i]`` per group and variable.

    All wanted ranks of all variables are selected together in two passes. The first takes ``further`` aggregates of
    ``value`` and a mergeable sketch that puts each rank between two values, a few of ``FINE`` parts of the rows
    apart. The second counts rows: those between two brackets as one number, those inside a bracket by value. Only
    the latter are ordered, at most ``10 / FINE`` of a large group's rows for a percentile. A row is never copied.
    """
    by = by or []
    keys, value, n = [*by, label], F.col("value"), F.col("__n")
    ordered = sorted(set(probs))
    # the margin has to cover the sketch's error and three ranks; small groups take a wider one, or all values
    margins = [(m, math.ceil(3 / (m - 1 / FINE))) for m in (4 / FINE, 0.004)]
    grid = [min(1.0, max(0.0, p + side * m)) for p in ordered for m, _ in margins for side in (-1, 1)]
    long = long_numbers(df, variables, by, label)
    first = materialize(
        long.groupBy(*keys).agg(
            F.count(value).alias("__n"),
            F.min(value).alias("__min"),
            F.max(value).alias("__max"),
            F.percentile_approx(value, grid, FINE).alias("__grid"),
            *(further or []),
        )
    )

    def edge(i: int, side: int, end: Column) -> Column:
        out = None
        for k, (margin, least) in enumerate(margins):
            beyond = not 0 < ordered[i] + (2 * side - 1) * margin < 1
            at = end if beyond else F.get("__grid", F.lit(2 * len(margins) * i + 2 * k + side))
            out = F.when(n >= least, at) if out is None else out.when(n >= least, at)
        return out.otherwise(end)

    lows = [edge(i, 0, F.col("__min")) for i in range(len(ordered))]
    highs = [edge(i, 1, F.col("__max")) for i in range(len(ordered))]
    edges = first.filter(n > 0).select(*keys, F.array(*lows).alias("__lows"), F.array(*highs).alias("__highs"))
    joined = null_safe_join(long.filter(value.isNotNull()), edges, keys)
    inside = F.exists(F.arrays_zip(F.col("__lows").alias("low"), F.col("__highs").alias("high")), lambda e: (e["low"] <= value) & (value <= e["high"]))
    gap = F.when(~inside, F.size(F.filter("__highs", lambda high: high < value)))
    counts = joined.groupBy(*keys, gap.alias("__gap"), F.when(inside, value).alias("__v")).agg(
        F.count(F.lit(1)).alias("ties"), F.min(value).alias("__at")
    )
    upto = W.partitionBy(*keys).orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = first.select(*keys, "__n")
    placed = null_safe_join(counts.withColumn("__end", F.sum("ties").over(upto)), totals, keys)

    def ranked(rank: Column) -> Column:
        here = (rank < F.col("__end")) & (rank >= F.col("__end") - F.col("ties"))
        known = F.coalesce("__v", F.raise_error(F.lit("rank outside its bracket")).cast("double"))
        return F.max(F.when(here, known))

    def percentile(p: float) -> Column:
        at = (n - 1) * F.lit(float(p))
        share = F.max(at - F.floor(at))
        low = ranked(F.floor(at))
        return F.when(share > 0, (1 - share) * low + share * ranked(F.floor(at) + 1)).otherwise(low)

    found = placed.groupBy(*keys).agg(F.array(*[percentile(p) for p in probs]).alias("p"))
    return null_safe_join(first.drop("__grid"), found, keys, "left")


def exact_percentiles(
    df: DataFrame, variables: list[str], probs: list[float], by: list[str] | None = None, label: str = "variable"
) -> DataFrame:
    """Interpolated (type 7) percentiles ``p[i]`` per group and variable; all-missing groups give no row."""
    table = percentile_table(df, variables, probs, by, label)
    return table.filter(F.col("__n") > 0).select(*(by or []), label, "p")


def scalar_percentiles(df: DataFrame, variable: str, probs: list[float]) -> DataFrame:
    """One row with ``p`` (NULL when there is no value)."""
    return exact_percentiles(df, [variable], probs).agg(F.first("p").alias("p"))


def _tie_key(df: DataFrame, tiebreak: str) -> Column:
    """Whole-number ids order themselves; all others are ordered as texts, a missing one first."""
    if isinstance(df.schema[tiebreak].dataType, T.IntegralType):
        return F.col(tiebreak).cast("bigint")
    return F.coalesce(F.col(tiebreak).cast("string"), F.lit(""))


#: Bytes of a text that a whole number holds in order.
_CHUNK = 7


def _chunk(text: Column, k: int) -> Column:
    """The k-th run of ``_CHUNK`` bytes of a text as a number, in the texts' order; a text that has ended comes first."""
    part = F.hex(F.substring(text.cast("binary"), _CHUNK * k + 1, _CHUNK))
    # the length tells a text that has ended from one that goes on with zero bytes
    return F.conv(F.rpad(part, 2 * _CHUNK, "0"), 16, 10).cast("bigint") * (_CHUNK + 1) + F.shiftright(F.length(part), 1)


def _ranked_texts(tied: DataFrame, group: list[str], text: str, wanted: list[tuple]) -> dict[tuple, str]:
    """The texts at wanted ranks of each group, ``(*group values, rank)``; by narrowing, a few bytes a round.

    A round finds the next bytes of every wanted text as order statistics of whole numbers, and goes on with the
    texts that begin so. As many rounds as the longest wanted text has runs of bytes.
    """
    spark, found = tied.sparkSession, {}
    # (group..., beginning so far) -> [(rank inside, rank wanted)]
    open_ = {}
    for *own, rank in wanted:
        open_.setdefault((*own, ""), []).append((rank, rank))
    fields = [f"`{g}` {tied.schema[g].dataType.simpleString()}" for g in group]
    k = 0
    while open_:
        rows = [(*state, ranks) for state, ranks in open_.items()]
        states = spark.createDataFrame(rows, ", ".join([*fields, "__begin string", "__places array<struct<rank: bigint, wanted: bigint>>"]))
        begin = F.hex(F.substring(F.col(text).cast("binary"), 1, _CHUNK * k)) if k else F.lit("")
        narrowed = tied.withColumn("__begin", begin).join(F.broadcast(states), [*group, "__begin"]).withColumn("__next", _chunk(F.col(text), k).cast("bigint"))
        keys = [*group, "__begin", "__places"]
        hits = order_statistics(narrowed, keys, "__next", lambda _n: F.col("__places")).collect()
        open_ = {}
        for hit in hits:
            own = tuple(hit[g] for g in group)
            number, length = divmod(hit["__next"], _CHUNK + 1)
            begin_hex = hit["__begin"] + f"{number:0{2 * _CHUNK}X}"[: 2 * length]
            if length < _CHUNK:
                found[(*own, hit["wanted"])] = bytes.fromhex(begin_hex).decode()
            else:
                open_.setdefault((*own, begin_hex), []).append((hit["offset"], hit["wanted"]))
        k += 1
    return found


def ntile_borders(df: DataFrame, sources: list[str], tiebreak: str, n: int = 4) -> dict[str, list[tuple]]:
    """First (value, tie key) of tiles 2..n of each column; the key is None if the value starts the tile.

    At most ``n - 1`` rows per column reach the driver.
    """
    rows = df.select(
        _tie_key(df, tiebreak).alias("__key"), *[drop_nan(F.col(s).cast("double")).alias(s) for s in sources]
    ).unpivot(["__key"], sources, "source", "value")

    def starts(count: Column) -> Column:
        size, extra = F.floor(count / n), F.pmod(count, F.lit(n))
        ranks = [(size * k + F.least(F.lit(k), extra)).cast("bigint") for k in range(1, n)]
        every = F.array(*[F.struct(r.alias("rank"), F.lit(k).alias("k")) for k, r in enumerate(ranks)])
        return F.filter(every, lambda t: t["rank"] < count)

    edges = order_statistics(rows, ["source"], "value", starts).collect()
    split = sorted({(e["source"], e["value"], e["offset"]) for e in edges if e["offset"] > 0})
    keys: dict[tuple, object] = {}
    if split:
        # Rows that tie with an edge value, and the wanted places among them.
        wanted = df.sparkSession.createDataFrame(split, "source string, value double, rank bigint")
        places = wanted.groupBy("source", "value").agg(F.collect_list(F.struct("rank")).alias("__places"))
        tied = rows.join(F.broadcast(places), ["source", "value"])  # at most n - 1 rows a column
        if isinstance(rows.schema["__key"].dataType, T.StringType):
            keys = _ranked_texts(tied.drop("__places"), ["source", "value"], "__key", split)
        else:
            group = ["source", "value", "__places"]
            for hit in order_statistics(tied, group, "__key", lambda _n: F.col("__places")).collect():
                keys[hit["source"], hit["value"], hit["rank"]] = hit["__key"]
    borders: dict[str, list[tuple]] = {source: [] for source in sources}
    for e in sorted(edges, key=lambda e: e["k"]):
        borders[e["source"]].append((e["value"], keys.get((e["source"], e["value"], e["offset"]))))
    return borders


def add_ntiles(df: DataFrame, tiles: dict[str, str], tiebreak: str, n: int = 4) -> DataFrame:
    """Exact n-tiles of several columns (``new -> source``), missing values untiled.

    Tiles are filled in order of (value, tiebreak); the tiebreak must be unique.
    Every row compares itself with the n-1 borders, so the table itself is
    neither sorted nor shuffled. ``df`` is read up to four times; pass a stored
    table when it is costly to compute.
    """
    borders = ntile_borders(df, list(tiles.values()), tiebreak, n)
    tie = _tie_key(df, tiebreak)

    def tile(source: str) -> Column:
        value = drop_nan(F.col(source).cast("double"))
        out = F.lit(1)
        for edge, key in borders[source]:
            at_edge = (value == edge) if key is None else (value == edge) & (tie >= key)
            out = out + ((value > edge) | at_edge).cast("int")
        return F.when(value.isNotNull(), out)

    return df.withColumns({name: tile(source) for name, source in tiles.items()})
