"""Row-level expressions: parsing, cleaning, classification, rates."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import clip_high, clip_low, ratio

# White space collapsed by "squish", and the first-number pattern.
WHITE_SPACE = r"[\t\n\f\r\p{Z}]+"
FIRST_NUMBER = r"-?\d+\.?\d*"
# Signs one by one are looked up in a table, ranges are tried one after the other for each sign of a text.
UNCLEAN = f"[^{string.ascii_lowercase}{string.digits}.]+"

# Upper age bound (exclusive) -> label / remaining years.
AGE_BANDS = [(40, "18-39"), (50, "40-49"), (60, "50-59"), (70, "60-69"), (80, "70-79")]
AGE_BAND_LAST = "80+"
LIFE_TABLE = [
    (20, 60.0), (25, 55.5), (30, 50.8), (35, 46.1), (40, 41.5), (45, 36.9), (50, 32.4), (55, 28.1),
    (60, 23.9), (65, 20.0), (70, 16.4), (75, 13.1), (80, 10.2), (85, 7.8), (90, 5.9),
]
LIFE_TABLE_LAST = 4.4

# Ordered code patterns over the concatenated cancer codes.
CANCER_TYPES = [
    ("C3[0-9]|C4[0-1]", "respiratory_thoracic"),
    ("C1[5-9]|C2[0-1]|C26", "gastrointestinal"),
    ("C5[0-8]", "breast_female_genital"),
    ("C6[0-8]", "genitourinary_male"),
    ("C8[1-9]|C9[0-6]", "hematologic"),
    ("C4[3-9]", "skin_soft_tissue"),
]
CANCER_TYPE_LAST = "other_or_mixed"

# Discharge keywords.
DISCHARGE_KEYWORDS = {
    "hospital_mortality": "death|expired|deceased",
    "hospice_discharge": "hospice",
    "home_discharge": "home",
    "facility_discharge": "rehab|skilled|snf|ltach|facility|nursing",
}


def squish(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, WHITE_SPACE, " "))


def clean_string(col: Column) -> Column:
    """Lower case; every run outside ``a-z 0-9 .`` becomes one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(col.cast("string")), UNCLEAN, " "))


def normalize_text(col: Column) -> Column:
    """Missing text to '', white space squished, lower case."""
    return F.lower(squish(F.coalesce(col, F.lit(""))))


def to_num(col: Column) -> Column:
    """First signed decimal inside a text: ``<0.01`` is 0.01, ``1,200`` is 1."""
    found = F.regexp_extract(col.cast("string"), FIRST_NUMBER, 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def try_num(col: Column) -> Column:
    """Whole-text numeric cast, NULL where the text is not a number; NaN is missing."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def upper_code(col: Column) -> Column:
    return F.upper(col.cast("string"))


_OFFSET = r"\s*(Z|UTC|[+-]\d{2}:?\d{2})?\s*$"


def _in_utc(clock: Column, offset: Column) -> Column:
    """A wall clock with an offset like ``-06:00`` as UTC; ``Z``, ``UTC`` and nothing mean UTC."""
    minutes = F.coalesce(F.regexp_extract(offset, r"(\d{2}):?(\d{2})$", 1).try_cast("int"), F.lit(0)) * 60 + F.coalesce(
        F.regexp_extract(offset, r"(\d{2}):?(\d{2})$", 2).try_cast("int"), F.lit(0)
    )
    east = F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)
    return clock - F.make_dt_interval(F.lit(0), F.lit(0), east)


def parse_ymd_hms(col: Column) -> Column:
    """Year-month-day hour:minute:second text, with or without an offset, to timestamp_ntz in UTC, anything else NULL."""
    shape = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T ]+(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)" + _OFFSET
    iso = F.regexp_replace(col, shape, "$1-$2-$3 $4:$5:$6")
    return F.when(col.rlike(shape), _in_utc(iso.try_cast("timestamp_ntz"), F.regexp_extract(col, shape, 7)))


def parse_dt_column(kind: T.DataType, col: Column) -> Column:
    """One UTC clock: wall-clock timestamps pass through, instants are given in UTC whatever the session's
    zone, text is parsed, unparseable text is NULL."""
    if isinstance(kind, T.StringType):
        return parse_ymd_hms(col)
    if isinstance(kind, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
    return col


def parse_dt(df: DataFrame, name: str) -> Column:
    """A column of a table on one UTC clock, by its type (see ``parse_dt_column``)."""
    return parse_dt_column(df.schema[name].dataType, F.col(name))


def parse_flexible_datetime(col: Column, zone: str = "America/Chicago") -> Column:
    """Year-first or month-first date with optional time, read as wall clock in ``zone``, given in UTC.

    Dates may be separated by ``- / .``, name their month (``Jan 5, 2024``, ``5 January 2024``) or have no
    separators (``20240105``, ``20240105 0830``). Two-digit years (69-99 are 19xx) are accepted month-first, and
    year-first where the first number is no month. A time with an offset or ``Z`` needs no zone. A wall clock
    skipped by daylight saving moves forward one hour.
    """
    clock = r"(?:[T ,]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?)?" + _OFFSET
    month, day = r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
    named = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    # Each shape with the places of year, month and day; one text of a fixed form comes out of all of them.
    shapes = [
        (rf"^\s*(\d{{4}})[-/.]{month}[-/.]{day}{clock}", "$1-$2-$3"),
        (rf"^\s*{month}[-/.]{day}[-/.](\d{{4}}|\d{{2}}){clock}", "$3-$1-$2"),
        (rf"^\s*(\d{{2}})[-/.]{month}[-/.]{day}{clock}", "$1-$2-$3"),
        (rf"(?i)^\s*{named}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){clock}", "$3-$1-$2"),
        (rf"(?i)^\s*(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{named}\.?,?[\s-]+(\d{{4}}){clock}", "$3-$2-$1"),
        (r"^\s*(\d{4})(\d{2})(\d{2})(?:[T ]*(\d{2}):?(\d{2})(?::?(\d{2}(?:\.\d+)?))?)?" + _OFFSET, "$1-$2-$3"),
    ]
    text = F.coalesce(*[F.when(col.rlike(shape), F.regexp_replace(col, shape, f"{date} $4:$5:$6|$7")) for shape, date in shapes])
    for found, wanted in (
        (" ::", " 0:0:0"), (r":\|", ":0|"), ("^([0-6][0-8]|[0-5]9)-", "20$1-"), (r"^(69|[7-9]\d)-", "19$1-"),
    ):
        text = F.regexp_replace(text, found, wanted)

    def finish(text: Column) -> Column:
        name = F.lower(F.regexp_extract(text, "-([A-Za-z]{3})-", 1))
        number = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int").cast("string")
        whole = F.when(name == "", text).otherwise(F.concat(F.substring(text, 1, 5), number, F.substring(text, F.lit(9), F.length(text))))
        local, offset = F.split_part(whole, F.lit("|"), F.lit(1)).try_cast("timestamp_ntz"), F.split_part(whole, F.lit("|"), F.lit(2))
        return F.when(offset == "", F.convert_timezone(F.lit(zone), F.lit("UTC"), local)).otherwise(_in_utc(local, offset))

    # The text is used many times but computed once.
    return F.get(F.transform(F.array(text), finish), 0)


def pad_fips(col: Column) -> Column:
    """First run of digits, left-padded with zeros to five, never cut."""
    digits = F.nullif(F.regexp_extract(col.cast("string"), r"\d+", 0), F.lit(""))
    return F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)


def _steps(col: Column, steps: list, last) -> Column:
    out = F.when(col.isNull(), F.lit(None))
    for bound, value in steps:
        out = out.when(col < bound, F.lit(value))
    return out.otherwise(F.lit(last))


def age_band(age: Column) -> Column:
    return _steps(age, AGE_BANDS, AGE_BAND_LAST)


def remaining_life_expectancy(age: Column) -> Column:
    return _steps(age, LIFE_TABLE, LIFE_TABLE_LAST)


def age_cap(age: Column, maximum: float = 119) -> Column:
    """Implausible ages become missing."""
    return F.when(age <= maximum, age)


def age_at_date(birth_date: Column, at: Column) -> Column:
    return F.datediff(at, birth_date) / F.lit(365.25)


def phenotype_tier(high: Column, probable: Column, possible: Column) -> Column:
    return (
        F.when(high == 1, "high_confidence")
        .when(probable == 1, "probable")
        .when(possible == 1, "possible")
        .otherwise("not_flagged")
    )


def cancer_type_broad(codes: Column) -> Column:
    out = F
    for pattern, label in CANCER_TYPES:
        out = out.when(codes.rlike(pattern), label)
    return out.otherwise(CANCER_TYPE_LAST)


def discharge_flag(name_clean: Column, category_clean: Column, keywords: str) -> Column:
    """Keyword in either text; stays missing if one is missing and the other has no match."""
    return (mentions(name_clean, keywords) | mentions(category_clean, keywords)).cast("int")


def days_between(start: Column, end: Column) -> Column:
    """Fractional days."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6)


def whole_days_between(start: Column, end: Column) -> Column:
    """Difference of calendar dates."""
    return F.datediff(F.to_date(end), F.to_date(start))


def rate_se(events: Column, n: Column) -> Column:
    rate = ratio(events, n)
    return F.sqrt(rate * (1 - rate) / n)


def rate_with_ci(events: Column, n: Column, z: float = 1.96) -> dict[str, Column]:
    """Proportion, standard error and Wald limits kept inside [0, 1]."""
    rate, se = ratio(events, n), rate_se(events, n)
    return {
        "rate": rate,
        "se": se,
        "rate_low": clip_low(rate - z * se, 0.0),
        "rate_high": clip_high(rate + z * se, 1.0),
    }


def extract_snippet(text: Column, pattern: str | Column, window: int = 90) -> Column:
    """First match with up to ``window`` characters on each side, squished; NULL without a match.

    Splitting once at the first match gives the text before and after it, so
    positions are in characters and the text is searched only once.
    """

    def cut(parts: Column) -> Column:
        before, after = F.length(parts[0]), F.length(parts[1])
        start = F.greatest(F.lit(1), before + 1 - window)
        stop = F.length(text) - after + F.least(after, F.lit(window))
        return F.when(F.size(parts) == 2, squish(F.substring(text, start, stop - start + 1)))

    return F.transform(F.array(F.split(text, case_insensitive(pattern), 2)), cut)[0]


def case_insensitive(pattern: str | Column) -> str | Column:
    """Unicode-aware, case-insensitive form of a pattern."""
    if isinstance(pattern, Column):
        return F.concat(F.lit("(?iU)(?:"), pattern, F.lit(")"))
    return "(?iU)(?:" + pattern + ")"


# One part of a pattern: a bar, a sign that stands for itself, or what matches other signs; then how often.
_PART = re.compile(
    r"(?P<bar>\|)|(?:(?P<sign>[^\\\[\](){}^$|?*+.])|\\[bBsSdDwW]|\\[^A-Za-z0-9]|\[\^?[^\[\]\\^&]+\]|\.|\((?!\?)[^()|\[\]\\]*\)(?=\?))"
    r"(?P<times>(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?)?"
)


def alternatives(pattern: str) -> list[tuple[str, list[str]]] | None:
    """The alternatives of a pattern, each with lower-case literals that every match of it contains.

    None for other syntax than literals, dots, classes, escapes of one sign, optional groups and counts, where
    alternatives might depend on each other. An alternative without literals of three letters gives its longest, if any.
    """
    found, start, at, pieces = [], 0, 0, [""]
    while at <= len(pattern):
        part = _PART.match(pattern, at) if at < len(pattern) else None
        if at < len(pattern) and part is None:
            return None
        if part is None or part["bar"]:
            if start == at:
                return None
            words = [re.sub(" +", " ", piece).strip() for piece in pieces]
            words = [w.lower() for w in words if re.fullmatch(r"[A-Za-z0-9 \-]+", w)]
            found.append((pattern[start:at], list(dict.fromkeys([w for w in words if len(w) > 2] or words))))
            start, pieces = at + 1, [""]
        elif part["sign"] and not part["times"]:
            pieces[-1] += part["sign"]
        else:
            pieces.append("")
        at = part.end() if part else at + 1
    return found


def literals_in(search: Column, literals: Iterable[str], native: bool = False) -> Column:
    """Those of the literals that the search text contains, as an array: all are met in one pass over the text.

    The pass is Aho-Corasick's in the Python worker; a substring search for each literal took most of the time.
    ``native`` searches for each in Spark, without Python.
    """
    words = list(literals)
    if not words:
        return F.array().cast("array<string>")
    if native:
        all_words = F.array(*map(F.lit, words))
        return F.transform(F.array(search), lambda text: F.filter(all_words, lambda word: F.contains(text, word)))[0]  # the text is made once

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield pa.array([sorted({word for _, word in automaton.iter(text.as_py())}) for text in texts], pa.list_(pa.string()))

    return F.arrow_udf(found, "array<string>")(search)


def alternatives_in(literals: Column, parts: list[tuple[str, list[str]]]) -> Column:
    """A pattern of the alternatives whose literals are all among the given ones; empty if there is none.

    It finds the same first match as all alternatives.
    """

    def possible(words: list[str]) -> Column:
        out = F.lit(True)
        for word in words:
            out = out & F.array_contains(literals, word)
        return out

    return F.concat_ws("|", *[F.when(possible(words), F.lit(part)) for part, words in parts], F.lit(None).cast("string"))


def needed_literals(pattern: str) -> list[str] | None:
    """A lower-case literal per alternative that every match of it contains.

    None when some alternative has none, or for syntax beyond literals, dots,
    escapes and ``? * +`` (then there is no shortcut).
    """
    plain = re.sub(r"\([^()|]*\)\?", "\0", pattern)
    if re.search(r"[()\[\]{}^$]", plain):
        return None
    out = []
    for alternative in plain.split("|"):
        pieces = re.sub(r"(\\.|[^\\])[?*+]+|\\.|\.", "\0", alternative).split("\0")
        best = max((piece.strip() for piece in pieces), key=len)
        if not re.fullmatch(r"[A-Za-z0-9 \-]+", best):
            return None
        out.append(best.lower())
    return list(dict.fromkeys(out))


def is_plain(pattern: str) -> bool:
    """Only literal alternatives, so that containing one of them is a match."""
    return all(re.fullmatch(r"[a-z0-9\-]+( [a-z0-9\-]+)*", part) for part in pattern.split("|"))


def mentions(col: Column, pattern: str) -> Column:
    """Pattern found in a cleaned text; plain alternatives need no regular expression."""
    if not is_plain(pattern):
        return col.rlike(pattern)
    first, *rest = pattern.split("|")
    out = col.contains(first)
    for literal in rest:
        out = out | col.contains(literal)
    return out


def search_text(clean_text: Column) -> Column:
    """Normalized text for ``may_match``: two letters that case-insensitive search
    equates with i and s keep their own lower-case form, so they are mapped."""
    return F.when(
        clean_text.contains("\u0131") | clean_text.contains("\u017f"), F.translate(clean_text, "\u0131\u017f", "is")
    ).otherwise(clean_text)


def may_match(search: Column, pattern: str) -> Column | None:
    """Cheap necessary condition, on the search text, for a match in the raw or the normalized text."""
    literals = needed_literals(pattern)
    if literals is None:
        return None
    out = search.contains(literals[0])
    for literal in literals[1:]:
        out = out | search.contains(literal)
    return out
