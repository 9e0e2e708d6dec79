import csv

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from cohortspark.operators import outliers
from cohortspark.sources import io, lookups


def test_threshold_csv(spark, tmp_path):
    path = tmp_path / "limits.csv"
    path.write_bytes("﻿lab_category,lower_limit,upper_limit\nalbumin,0,15\nbicarb, 0,50 \nodd,x,1\n".encode())
    got = sorted(map(tuple, lookups.threshold_lookup(spark, str(path), "lab_category").collect()))
    assert got == [("albumin", 0.0, 15.0), ("bicarb", 0.0, 50.0), ("odd", None, 1.0)]
    path.write_text("k,lower_limit,upper_limit\na,0,1\na,0,2\n")
    with pytest.raises(ValueError, match="repeats"):
        lookups.threshold_lookup(spark, str(path), "k")
    assert lookups.threshold_lookup(spark, str(path), "k", strict=False).count() == 2


def test_limit_tables_have_unique_keys():
    for limits in (lookups.LAB_LIMITS, lookups.VITAL_LIMITS, lookups.RESPIRATORY_LIMITS):
        assert len({name for name, _, _ in limits}) == len(limits) and all(lo < hi for _, lo, hi in limits)


def test_concept_csv_backslashes(spark, tmp_path):
    path = tmp_path / "concepts.csv"
    path.write_text('note_domain,concept_group,concept_name,pattern\nall,g,n,"\\\\bword\\\\b|cycle\\\\s*\\\\d+"\nall,g,m,other\n')
    concepts = lookups.read_concepts(spark, str(path))
    assert concepts[0] == ("all", "g", "n", r"\bword\b|cycle\s*\d+")
    assert lookups.concept_patterns(concepts, "radiology") == {"g": r"\bword\b|cycle\s*\d+|other"}


def test_quoted_notes(spark, tmp_path):
    """Doubled quotes, commas, line breaks and backslashes, as other programs write and read them."""
    path = tmp_path / "notes.csv"
    path.write_text('MRN,HAR,NOTE_TEXT,PROC_NAME\nM1,H1,"pt said ""no, never"" today, ok",CT\nM2,H2,"two\nlines \\n",XR\n')
    rows = [tuple(r) for r in io.read_any(spark, str(path), "csv").collect()]
    assert rows == [("M1", "H1", 'pt said "no, never" today, ok', "CT"), ("M2", "H2", "two\nlines \\n", "XR")]
    texts = ['a "quoted, text" b', "line\nbreak\r\nhere", " blanks ", "back\\slash\\", '"', "", None, 'end"', "é,;|"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    folder = io.write_table(df, str(tmp_path / "out.csv"), "csv")
    assert [r.t for r in sorted(io.read_csv_required(spark, folder, df.schema).collect())] == [t or None for t in texts]
    with open(next((tmp_path / "out.csv").glob("part-*")), newline="", encoding="utf-8") as handle:
        assert [row[1] for row in list(csv.reader(handle))[1:]] == [t or "" for t in texts]


def test_optional_and_required(spark, tmp_path):
    assert io.read_optional(spark, str(tmp_path / "none.parquet")) is None
    df = spark.createDataFrame([(1, "007")], "a int, b string")
    for kind in ("csv", "parquet"):
        path = io.write_table(df, str(tmp_path / f"t.{kind}"), kind)
        assert io.read_any(spark, path, kind).first().b == "007"
    with pytest.raises(ValueError):
        io.read_any(spark, "x", "fst")
    with pytest.raises(ValueError, match="labs"):
        io.require_tables({"adt": df, "labs": None}, ["adt", "labs"])
    with pytest.raises(ValueError, match="missing required columns: z"):
        io.require_columns(df, ["a", "z"])
    with pytest.raises(ValueError, match="nope"):
        io.load_study_tables(spark, str(tmp_path), ["t", "nope"])
    assert io.ensure_columns(df, {"a": None, "c": io.optional_column(df, "c")}).columns == ["a", "b", "c"]
    stored = io.materialize(df)
    assert stored.schema == df.schema and stored.first() == df.first()


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"tables_path": "/d", "site": ""}')
    settings = io.load_settings(str(path))
    assert io.setting(settings, "tables_dir") == "/d" and io.setting(settings, "site", "S") == "S"
    with pytest.raises(KeyError):
        io.setting(settings, "site", required=True)
    assert io.load_settings(str(tmp_path / "no.json"), required=False) == {}


def test_replace_outliers(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 16.0), ("a", 0.0), ("z", 1.0), (None, 1.0), ("a", None)], "c string, v double")
    limits = lookups.limits_table(spark, [("a", 0, 15)], "c")
    got = sorted(map(tuple, outliers.replace_outliers(df, limits, "c", "v").collect()), key=str)
    assert got == sorted([("a", 5.0), ("a", None), ("a", 0.0), ("z", None), (None, None), ("a", None)], key=str)
    kept = sorted(map(tuple, outliers.replace_outliers(df, limits, "c", "v", keep_unruled=True).collect()), key=str)
    assert kept == sorted([("a", 5.0), ("a", None), ("a", 0.0), ("z", 1.0), (None, 1.0), ("a", None)], key=str)


def test_laid_out_tables_join_without_an_exchange(spark, tmp_path):
    left = spark.createDataFrame([(i % 50, i) for i in range(500)], "hospitalization_id bigint, a int")
    right = spark.createDataFrame([(i, str(i)) for i in range(60)] + [(None, "x")], "hospitalization_id bigint, b string")
    folder = str(tmp_path / "laid")
    saved = io.save_laid_out({"left": left, "right": right}, folder, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for tables in (saved, io.open_laid_out(spark, folder, ["left", "right"], buckets=4)):
            joined = tables["left"].join(tables["right"], "hospitalization_id")
            counted = joined.groupBy("hospitalization_id").count()
            assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == 500 and counted.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in {t.name for t in spark.catalog.listTables() if t.name.startswith(("left_cohort", "right_cohort"))}:
            spark.sql(f"drop table {table}")


def test_stored_frames_leave_no_shuffle_files(spark, monkeypatch):
    writing = []

    def recording(self, path, write=DataFrameWriter.parquet):
        writing.append(spark.conf.get(io.SHUFFLES_GO))
        return write(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", recording)
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().cache()
    stored = io.materialize(rows.groupBy("count").agg(F.sum("k").alias("k")))
    assert writing == ["true"] and spark.conf.get(io.SHUFFLES_GO, "false") == "false"
    assert tuple(stored.first()) == (100, 45) and rows.count() == 10
    rows.unpersist()
    with pytest.raises(Exception, match="FAILED_TO_PARSE|CAST_INVALID_INPUT"):
        io.materialize(spark.sql("select cast('x' as int) as k from range(3) distribute by id"))
    assert spark.conf.get(io.SHUFFLES_GO, "false") == "false"
