import datetime as dt
import random
import re

from pyspark.sql import functions as F

from clinical_views import study_tables
from cohortspark.operators import windows
from cohortspark.plans import phenotype
from cohortspark.sources import io

T0 = dt.datetime(2024, 1, 10)
HOUR = dt.timedelta(hours=1)


def anchors(spark):
    rows = [(1, T0), (2, T0), (3, None)]
    return spark.createDataFrame(rows, "hospitalization_id bigint, first_icu_in timestamp_ntz")


def test_window_is_closed_and_null_anchor_has_no_events(spark):
    times = [T0 - 24 * HOUR, T0 - 24 * HOUR - dt.timedelta(seconds=1), T0 + 72 * HOUR, T0 + 73 * HOUR, None]
    events = spark.createDataFrame(
        [(i, t) for i in (1, 3, 9) for t in times], "hospitalization_id bigint, t timestamp_ntz"
    )
    for part_rows in (1, 1000):
        got = windows.anchored_interval_join(events, anchors(spark), "t", part_rows=part_rows).collect()
        assert sorted((r.hospitalization_id, r.t) for r in got) == [(1, times[0]), (1, times[2])]


def test_features_do_not_depend_on_parts_or_partitions(spark):
    rng = random.Random(7)
    # One key holds most rows, many of them exact copies.
    rows = [
        (1 if rng.random() < 0.8 else 2, T0 + rng.randint(-40, 90) * HOUR, rng.choice(["Ferritin", "CRP", None]),
         None, rng.choice(["10", "<2", "3000", "bad", None]))
        for _ in range(2000)
    ]
    schema = "hospitalization_id bigint, lab_result_dttm timestamp_ntz, lab_category string, lab_name string, lab_value string"
    labs = spark.createDataFrame(rows + rows[:500] * 2, schema)
    results = set()
    for part_rows, parts in ((10_000, 1), (300, 5), (1000, 2)):
        out = phenotype.lab_features(labs.repartition(parts), anchors(spark), part_rows=part_rows)
        results.add(tuple(sorted(tuple(r) for r in out.select("hospitalization_id", "ferritin_max", "crp_max", "plt_min").collect())))
    assert len(results) == 1

    def number(x):
        return {"10": 10.0, "<2": 2.0, "3000": 3000.0}.get(x)

    want = []
    for key in (1, 2):
        inside = [r for r in rows if r[0] == key and T0 - 24 * HOUR <= r[1] <= T0 + 72 * HOUR]
        best = {
            n: max((number(r[4]) for r in inside if r[2] == n and number(r[4]) is not None), default=None)
            for n in ("Ferritin", "CRP")
        }
        want.append((key, best["Ferritin"], best["CRP"], None))
    assert results == {tuple(want)}


def without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def exchanges(df):
    """The keys of the hash exchanges of a plan, deepest last."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_a_hot_key_is_spread_and_only_it(spark):
    """With and without a broadcast the rows are the same; no row meets the bare key's partition."""
    hot = [(1, T0 + dt.timedelta(seconds=i), str(i)) for i in range(4000)]
    cold = [(i, T0 + HOUR, "x") for i in range(2, 8002)]  # a third of all events has key 1
    events = spark.createDataFrame(hot + cold, "hospitalization_id bigint, t timestamp_ntz, a string")
    stored = io.materialize(spark.createDataFrame([(i, T0) for i in range(1, 9000)], "hospitalization_id bigint, first_icu_in timestamp_ntz"))
    plain = windows.anchored_rows(events, stored, "t")
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString() and not exchanges(plain)
    without_broadcast(spark)
    try:
        assert windows.hot_parts(events, part_rows=500) == {1: 8}
        rows = windows.anchored_rows(events, stored, "t", part_rows=500)
        assert exchanges(rows) and all("__part" in keys for keys in exchanges(rows))
        assert rows.where("hospitalization_id = 1").select("__part").distinct().count() == 8
        assert rows.where("hospitalization_id > 1").select("__part").distinct().count() == 1
        assert sorted(map(tuple, rows.drop("__part").collect())) == sorted(map(tuple, plain.drop("__part").collect()))
        assert rows.count() == 12_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_features_of_a_cohort_share_one_exchange_of_events(spark):
    base = io.materialize(anchors(spark))
    make = lambda columns, rows: spark.createDataFrame(rows, "hospitalization_id bigint, " + columns)
    at = T0 + HOUR
    sources = [
        phenotype.resp_source(make("recorded_dttm timestamp_ntz, device_category string, fio2_set string", [(1, at, "IMV", "40"), (1, at, "imv ", "x"), (2, T0 - 30 * HOUR, "imv", "90")])),
        phenotype.vasopressor_source(make("admin_dttm string, med_name string, med_category string", [(1, "2024-01-10 01:00:00", "Norepinephrine", None)])),
        phenotype.crrt_source(make("recorded_dttm timestamp_ntz", [(2, at), (3, at)])),
        phenotype.steroid_rescue_source(make("admin_dttm timestamp_ntz, med_name string, med_category string, mar_action_group string", [(1, at, "Prednisone", None, "Administered"), (2, at, "prednisone", None, "held")])),
        phenotype.lab_source(make("lab_result_dttm timestamp_ntz, lab_category string, lab_name string, lab_value string", [(1, at, "CRP", None, "<12"), (1, T0 + 80 * HOUR, "crp", None, "99")])),
        phenotype.vital_source(make("recorded_dttm timestamp_ntz, vital_category string, vital_value double", [(1, at, "temp_c", 39.0), (1, T0 + 30 * HOUR, "temp_c", 41.0), (None, at, "temp_c", 40.0)])),
    ]
    found = {}
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            frame = windows.union_features(sources, base)
            # the union moves once; what moves after that is reduced to texts, then to keys
            moved = exchanges(frame)
            assert sum("__part" in keys and "__tag" not in keys for keys in moved) <= (2 if limit == "-1" else 0)  # events and anchors
            found[limit] = {r.hospitalization_id: r for r in frame.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["10m"] == found["-1"] and set(found["-1"]) == {1, 2}
    one, two = found["-1"][1], found["-1"][2]
    assert (one.any_imv, one.max_fio2, one.any_vasopressor, one.any_crrt, one.steroid_names, one.crp_max, one.temp_max) == (1, 40.0, 1, 0, "prednisone", 12.0, 39.0)
    assert (two.any_imv, two.any_crrt, two.any_steroid, two.crp_max, two.temp_max) == (0, 1, 0, None, None)


def test_absent_optional_tables_fall_back(spark):
    base = anchors(spark)
    blocks = [
        phenotype.resp_features(None, base), phenotype.vasopressor_features(None, base),
        phenotype.crrt_features(None, base), phenotype.steroid_rescue_features(None, base),
        phenotype.lab_flags(phenotype.lab_features(None, base)), phenotype.vital_features(None, base),
    ]
    rows = phenotype.feature_assembly(base, blocks).collect()
    assert len(rows) == 3
    for row in rows:
        assert row.any_imv == row.any_steroid == row.any_crrt == row.cytokine_storm_like == row.fever_flag == 0
        assert row.max_fio2 is None and row.steroid_names is None and row.plt_min is None


def test_steps_of_the_events_are_short_enough_to_compile(spark, sf_dir):
    """The JVM interprets methods of more than 8,000 bytes of code."""
    tables = study_tables(spark, sf_dir)
    base = io.materialize(spark.createDataFrame([(i, T0) for i in range(50)], "hospitalization_id bigint, first_icu_in timestamp_ntz"))
    sources = [
        phenotype.resp_source(tables["respiratory_support"]), phenotype.vasopressor_source(tables["medication_admin_continuous"]),
        phenotype.crrt_source(tables["crrt_therapy"]), phenotype.steroid_rescue_source(tables["medication_admin_intermittent"]),
        phenotype.lab_source(tables["labs"]), phenotype.vital_source(tables["vitals"]),
    ]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for limit in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            execution = windows.union_features(sources, base)._jdf.queryExecution()
            text = execution.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
            sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
