import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import scalars as sc
from cohortspark.functions import semantics as sem
from cohortspark.operators.outliers import parse_number


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "kind, fn, values, want",
    [
        ("string", sc.to_num, ["<0.01", "1,200", "", "-5.5 U/L", "abc", None], [0.01, 1.0, None, -5.5, None, None]),
        ("string", parse_number, ["<0.01", "1,200", "", "-5.5 U/L", "abc", None], [0.01, 1200.0, None, -5.5, None, None]),
        ("string", sc.try_num, ["1.5", " 2 ", "n/a", "NaN", None], [1.5, 2.0, None, None, None]),
        ("string", sc.pad_fips, ["1001", "17031.0", "123456", "", None], ["01001", "17031", "123456", None, None]),
        ("string", sc.clean_string, ["High-Flow  NC!", "0.9% Saline", None], ["high flow nc", "0.9 saline", None]),
        ("string", sc.normalize_text, [" A\r\n\tB  c ", None], ["a b c", ""]),
        ("int", sc.age_band, [39, 40, 79, 80, None], ["18-39", "40-49", "70-79", "80+", None]),
        ("int", sc.remaining_life_expectancy, [19, 20, 89, 90, None], [60.0, 55.5, 5.9, 4.4, None]),
        ("int", sc.age_cap, [119, 120, None], [119, None, None]),
        ("double", lambda c: sem.clip_low(c, 0.0), [-1.0, 2.0, None], [0.0, 2.0, None]),
        ("double", sem.drop_nan, [1.0, float("nan"), None], [1.0, None, None]),
        ("string", lambda c: sem.in_set(c, ["a"]), ["a", "b", None], [True, False, False]),
        ("string", sc.cancer_type_broad, ["C34.1", "C18.2 | C50.9", "C50.9", "C91.0", "Z85.3", "C43.9"],
         ["respiratory_thoracic", "gastrointestinal", "breast_female_genital", "hematologic", "other_or_mixed",
          "skin_soft_tissue"]),
    ],
)
def test_column_functions(spark, kind, fn, values, want):
    assert column(spark, values, kind, fn) == want


def test_parse_ymd_hms(spark):
    got = column(spark, ["2024-01-02 03:04:05", "2024/1/2T3:4:5Z", "2024-01-02", "x", None], "string", sc.parse_ymd_hms)
    stamp = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [stamp, stamp, None, None, None]


def test_parse_flexible_datetime(spark):
    texts = ["2024-07-04", "2024-01-04 05:06", "7/4/2024 1:02:03", "07/04/24", "1/2/75", "2024-13-01", "soon", "", None]
    got = column(spark, texts, "string", sc.parse_flexible_datetime)
    assert got == [
        dt.datetime(2024, 7, 4, 5), dt.datetime(2024, 1, 4, 11, 6), dt.datetime(2024, 7, 4, 6, 2, 3),
        dt.datetime(2024, 7, 4, 5), dt.datetime(1975, 1, 2, 6), None, None, None, None,
    ]


def test_discharge_flag_stays_missing(spark):
    df = spark.createDataFrame([("expired", None), (None, "home"), ("home", "home"), (None, None)], "a string, b string")
    got = [r.f for r in df.select(sc.discharge_flag(F.col("a"), F.col("b"), "death|expired").alias("f")).collect()]
    assert got == [1, None, 0, None]


def test_rate_with_ci(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (1, 4)], "e int, n int")
    rows = df.select(*[c.alias(k) for k, c in sc.rate_with_ci(F.col("e"), F.col("n")).items()]).collect()
    assert rows[0].rate is None and rows[0].se is None and rows[0].rate_low is None and rows[0].rate_high is None
    assert (rows[1].rate_low, rows[2].rate_high) == (0.0, 1.0)
    assert rows[3].rate_high == pytest.approx(0.25 + 1.96 * (0.25 * 0.75 / 4) ** 0.5)


def test_snippet_window(spark):
    text = "a" * 200 + "  Needle\n" + "b" * 200
    got = column(spark, [text, "needle", "none", "", None, "é" * 95 + "NEEDLE"], "string",
                 lambda c: sc.extract_snippet(c, "needle"))
    assert got == ["a" * 88 + " Needle " + "b" * 89, "needle", None, None, None, "é" * 90 + "NEEDLE"]


def test_needed_literals():
    assert sc.needed_literals(r"\bkeytruda\b|cycle\s*\d+") == ["keytruda", "cycle"]
    assert sc.needed_literals(r"favou?rs? .* irae") == ["favo"]
    assert sc.needed_literals(r"suspect(ed)? .* irae") == ["suspect"]
    assert sc.needed_literals(r"a[bc]d") is None
    assert sc.needed_literals(r"x|\d+") is None
    assert sc.is_plain("pulmonary edema|flash-edema") and not sc.is_plain(r"ici\b")


def test_times_with_offsets_names_and_no_separators(spark):
    from pyspark.sql import functions as F

    rows = [
        ("2024-01-05T08:30:00-06:00", "2024-01-05 14:30:00", "2024-01-05 14:30:00"), ("2024-01-05 08:30:00+0530", "2024-01-05 03:00:00", "2024-01-05 03:00:00"),
        ("2024-01-05T08:30:00Z", "2024-01-05 08:30:00", "2024-01-05 08:30:00"), ("2024-01-05 08:30:00", "2024-01-05 08:30:00", "2024-01-05 14:30:00"),
        ("Jan 5, 2024", None, "2024-01-05 06:00:00"), ("january 5th 2024 8:30", None, "2024-01-05 14:30:00"), ("5-JUL-2024", None, "2024-07-05 05:00:00"),
        ("20240105", None, "2024-01-05 06:00:00"), ("20240105 0830", None, "2024-01-05 14:30:00"), ("20240105T083015", None, "2024-01-05 14:30:15"),
        ("24-01-05", None, "2024-01-05 06:00:00"), ("01/05/24", None, "2024-01-05 06:00:00"), ("20241305", None, None), ("soon", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(sc.parse_ymd_hms(F.col("t")).cast("string"), sc.parse_flexible_datetime(F.col("t")).cast("string")).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_instants_are_given_in_utc_whatever_the_session_zone(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select timestamp '2024-01-05 08:30:00 America/Chicago' as t, timestamp_ntz '2024-01-05 08:30:00' as n")
    stored = df.withColumn("t", F.col("t"))
    for zone in ("UTC", "America/Chicago", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = stored.select(sc.parse_dt(stored, "t").cast("string").alias("t"), sc.parse_dt(stored, "n").cast("string").alias("n")).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert (row.t, row.n) == ("2024-01-05 14:30:00", "2024-01-05 08:30:00")
