"""Events inside a time window around a per-key anchor, and their features, for several event tables at once.

The event tables are put into one tagged union whose columns they share by type and place. The union is
joined with the (one row per key) anchors once and cut to each table's own window; times, texts and numbers are
parsed only behind the join, so only for the events of anchored keys. Windowed events are first reduced to one row per key, part, table
and distinct raw text, with the extremes of the number beside it, so text is cleaned and matched once per distinct
text of a key. A last aggregate gives all features of a key.

Pass stored anchors: the planner then knows their size in bytes. If that lets it broadcast them, no event moves.
If not, a sketch of frequent items finds the keys that hold many events, however they are distributed: only these
are spread over parts, as many as their number of events asks for, and only their anchors are repeated. All other
keys have one part. Without such keys the tables are cut to the anchored keys and joined by the bare key, each where
it lies: tables that are laid out in buckets of the key move no event.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_dt_column
from .anchors import KEY

#: Events of a key that one part holds; keys the sketch reports at most, and items it tracks.
PART_ROWS = 1_000_000
HOT_KEYS, TRACKED = 1_000, 10_000
HIGH, LOW = "__high", "__low"
_PART, _TAG, _AT = "__part", "__tag", "__at"
Get = Callable[[str], Column]


@dataclass(frozen=True)
class Feature:
    """A mergeable aggregate over the cleaned texts where ``cond`` holds.

    ``kind``: any (0/1), max or min of the number, names (distinct ``cond``
    text values, joined).
    """

    name: str
    kind: str
    cond: Column

    def aggregate(self) -> Column:
        if self.kind == "any":
            out = F.coalesce(F.max(self.cond.cast("int")), F.lit(0))
        elif self.kind == "max":
            out = F.max(F.when(self.cond, F.col(HIGH)))
        elif self.kind == "min":
            out = F.min(F.when(self.cond, F.col(LOW)))
        elif self.kind == "names":
            out = F.nullif(F.array_join(F.array_sort(F.collect_set(self.cond)), " | "), F.lit(""))
        else:
            raise ValueError(self.kind)
        return out.alias(self.name)


@dataclass(frozen=True)
class Source:
    """One event table and what is asked of it.

    ``raw`` are the columns that texts are made of, ``number`` one more that ``parse`` turns into a double.
    ``texts`` names the cleaned columns, given a way to get a raw column; ``keep`` and ``features`` get cleaned
    columns the same way.
    """

    events: DataFrame
    time: str
    raw: tuple[str, ...]
    texts: Callable[[Get], Mapping[str, Column]]
    features: Callable[[Get], list[Feature]]
    number: str | None = None
    parse: Callable[[Column], Column] = field(default=lambda column: column)
    keep: Callable[[Get], Column] | None = None
    before_hours: int = 24
    after_hours: int = 72


def window_bounds(anchor: Column, before_hours: int, after_hours: int) -> tuple[Column, Column]:
    """Both bounds belong to the window."""
    return anchor - F.expr(f"INTERVAL '{before_hours}' HOUR"), anchor + F.expr(f"INTERVAL '{after_hours}' HOUR")


def is_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own size of a stored frame lets it broadcast it."""
    text = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = text.rstrip("bkmg")
    limit = int(digits) * units.get(text[len(digits):] or "b", 1)
    return 0 <= int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def hot_parts(events: DataFrame, key: str = KEY, part_rows: int = PART_ROWS) -> dict:
    """Parts for the keys that hold more than ``part_rows`` events, by a mergeable sketch of frequent items.

    One pass over the key column; tasks send sketches of a fixed size. The sketch overestimates, never misses a key
    of more than a 7,500th of all events, and reports at most ``HOT_KEYS``.
    """
    found = events.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED})")).first()[0]
    return {item["item"]: -(-item["count"] // part_rows) for item in found or [] if item["count"] > part_rows}


def anchored(events: DataFrame, anchors: DataFrame, spread: Column, key: str, part_rows: int) -> DataFrame:
    """Events with their anchor's columns and the part of the key they are in; an inner join on the key."""
    if is_broadcast(anchors):
        return events.join(anchors, key).withColumn(_PART, F.lit(0))
    parts = hot_parts(events, key, part_rows)
    if not parts:
        # by the bare key, and cut to the anchored keys first: tables that lie in buckets of the key then do not move
        return events.join(anchors.select(key), key, "left_semi").join(anchors, key).withColumn(_PART, F.lit(0))
    kind = events.schema[key].dataType
    table = events.sparkSession.createDataFrame(list(parts.items()), T.StructType([T.StructField(key, kind), T.StructField("__parts", T.LongType())]))
    many = F.coalesce(F.col("__parts"), F.lit(1))
    # at most ``HOT_KEYS`` rows are broadcast
    left = events.join(F.broadcast(table), key, "left").withColumn(_PART, F.pmod(F.xxhash64(spread), many)).drop("__parts")
    right = anchors.join(F.broadcast(table), key, "left").withColumn(_PART, F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("__parts")
    return left.join(right, [key, _PART])


def anchored_rows(
    events: DataFrame,
    anchors: DataFrame,
    time: str,
    before_hours: int = 24,
    after_hours: int = 72,
    key: str = KEY,
    anchor: str = "first_icu_in",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Events of anchored keys inside the window, with the part of the key they were spread to."""
    # The bounds are computed once per anchor, not once per event.
    first, last = window_bounds(F.col(anchor), before_hours, after_hours)
    right = anchors.filter(F.col(anchor).isNotNull()).select(key, anchor, first.alias("__first"), last.alias("__last"))
    joined = anchored(events.filter(F.col(time).isNotNull()), right, F.col(time), key, part_rows)
    return joined.filter(F.col(time).between(F.col("__first"), F.col("__last"))).drop("__first", "__last")


def anchored_interval_join(events: DataFrame, anchors: DataFrame, time: str, **window) -> DataFrame:
    """Events inside the window, with the anchor column."""
    return anchored_rows(events, anchors, time, **window).drop(_PART)


class _Slots:
    """Columns of the union that the sources' own columns share: the first of a type, the second of it, and so on.

    A struct for each source instead would widen every row, and make methods too long for the JVM to compile.
    """

    def __init__(self, name: str, sources: list[Source], columns: Callable[[Source], Sequence[str]]):
        self.kinds: dict[str, T.DataType] = {}
        self.of: list[dict[str, str]] = []
        places: dict[tuple, str] = {}
        for s in sources:
            used: dict[T.DataType, int] = {}
            own = {}
            for column in columns(s):
                kind = s.events.schema[column].dataType
                used[kind] = used.get(kind, 0) + 1
                own[column] = places.setdefault((kind, used[kind]), f"{name}{len(places)}")
                self.kinds[own[column]] = kind
            self.of.append(own)

    def columns(self, i: int) -> list[Column]:
        """All slots, those of source ``i`` filled."""
        filled = {slot: column for column, slot in self.of[i].items()}
        return [(F.col(filled[slot]) if slot in filled else F.lit(None)).cast(kind).alias(slot) for slot, kind in self.kinds.items()]


def union_features(
    sources: list[Source], anchors: DataFrame, key: str = KEY, anchor: str = "first_icu_in", part_rows: int = PART_ROWS
) -> DataFrame:
    """One row per key that has a windowed event of any source, with the features of all sources.

    A source without a windowed event of the key gives 0 for its ``any`` features and missing values for the rest.
    """
    times, raws = _Slots("__t", sources, lambda s: [s.time]), _Slots("__r", sources, lambda s: s.raw)
    numbers = _Slots("__n", sources, lambda s: [s.number] if s.number else [])

    def tagged(i: int, s: Source) -> DataFrame:
        known = s.events.filter(F.col(s.time).isNotNull())
        return known.select(key, F.lit(i).alias(_TAG), *[c for slots in (times, raws, numbers) for c in slots.columns(i)])

    union = reduce(DataFrame.unionByName, [tagged(i, s) for i, s in enumerate(sources)])
    # from the stored anchors themselves, so that their size is known; bounds are computed once per anchor
    windows = list(dict.fromkeys((s.before_hours, s.after_hours) for s in sources))
    bounds = [b.alias(f"__{side}{w}") for w, hours in enumerate(windows) for side, b in zip(("first", "last"), window_bounds(F.col(anchor), *hours), strict=True)]
    right = anchors.select(key, *bounds)
    rows = anchored(union, right, F.struct(_TAG, *times.kinds), key, part_rows)

    def choose(column: Callable[[int, Source], Column | None], otherwise: Column) -> Column:
        out = None
        for i, s in enumerate(sources):
            value = column(i, s)
            if value is not None:
                out = F.when(F.col(_TAG) == i, value) if out is None else out.when(F.col(_TAG) == i, value)
        return otherwise if out is None else out.otherwise(otherwise)

    # one time slot of an event is filled
    at = F.coalesce(*[parse_dt_column(kind, F.col(slot)) for slot, kind in times.kinds.items()])
    inside = F.lit(False)
    for w, hours in enumerate(windows):
        own = [i for i, s in enumerate(sources) if (s.before_hours, s.after_hours) == hours]
        inside = inside | (F.col(_TAG).isin(own) & F.col(_AT).between(F.col(f"__first{w}"), F.col(f"__last{w}")))
    number = choose(lambda i, s: None if s.number is None else s.parse(F.col(numbers.of[i][s.number])), F.lit(None).cast("double"))
    # behind the join only raw texts are left, so that equal texts of a key meet
    numbered = rows.withColumn(_AT, at).filter(inside).select(key, _PART, _TAG, *raws.kinds, number.alias("__number"))
    reduced = numbered.groupBy(key, _PART, _TAG, *raws.kinds).agg(F.max("__number").alias(HIGH), F.min("__number").alias(LOW))

    def raw_of(i: int) -> Get:
        return lambda c: F.col(raws.of[i][c])

    def clean_of(i: int) -> Get:
        return lambda c: F.col(f"__c{i}")[c]

    cleaned = []
    for i, s in enumerate(sources):
        own = s.texts(raw_of(i))
        if own:
            cleaned.append(F.when(F.col(_TAG) == i, F.struct(*[c.alias(n) for n, c in own.items()])).alias(f"__c{i}"))
    clean = reduced.select(key, _TAG, HIGH, LOW, *cleaned)
    clean = clean.filter(choose(lambda i, s: None if s.keep is None else s.keep(clean_of(i)), F.lit(True)))
    features = [
        Feature(f.name, f.kind, F.when(F.col(_TAG) == i, f.cond)).aggregate() for i, s in enumerate(sources) for f in s.features(clean_of(i))
    ]
    return clean.groupBy(key).agg(*features)


def anchored_features(
    events: DataFrame,
    anchors: DataFrame,
    time: str,
    texts: Mapping[str, Column],
    features: list[Feature],
    number: str | None = None,
    parse: Callable[[Column], Column] = lambda column: column,
    keep: Column | None = None,
    **window,
) -> DataFrame:
    """One row per key that has a windowed event of one table.

    The events' columns besides key, time and ``number`` are the raw texts;
    ``texts`` names the cleaned columns that ``keep`` and the features use.
    """
    key = window.get("key", KEY)
    rows = anchored_rows(events, anchors, time, **window)
    value = F.lit(None).cast("double") if number is None else parse(F.col(number))
    raw = [c for c in events.columns if c not in (key, time, number)]
    numbered = rows.select(key, _PART, *raw, value.alias("__number"))
    reduced = numbered.groupBy(key, _PART, *raw).agg(F.max("__number").alias(HIGH), F.min("__number").alias(LOW))
    cleaned = reduced.select(key, HIGH, LOW, *[column.alias(name) for name, column in texts.items()])
    if keep is not None:
        cleaned = cleaned.filter(keep)
    return cleaned.groupBy(key).agg(*[f.aggregate() for f in features])
