import datetime as dt
import random

from cohortspark.operators import trajectories

T0 = dt.datetime(2024, 1, 1)


def test_fill_matches_a_sequential_pass(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(hours=rng.randint(0, 400)), i, rng.choice([None, None, 1.0, 2.0, 3.0]))
        for i in range(800)
    ]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, i int, x double")
    want, last = [], {}
    for k, t, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = x if x is not None else last.get(k)
        want.append((i, last[k]))
    for chunk in ("day", "month"):
        got = trajectories.waterfall_fill(df, "k", "t", ["x"], ["i"], chunk).select("i", "x").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_stitching_matches_a_sequential_pass(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        start = T0 + dt.timedelta(hours=rng.randint(0, 4000))
        rows.append((rng.choice([1, 1, 2]), i, start, start + dt.timedelta(hours=rng.randint(1, 60)) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "patient_id int, hospitalization_id int, admission_dttm timestamp_ntz, discharge_dttm timestamp_ntz")
    want, reach, number = [], {}, {}
    for p, h, a, d in sorted(rows, key=lambda r: (r[2], r[1])):
        if p not in reach or reach[p] is None or a > reach[p] + dt.timedelta(hours=6):
            number[p] = number.get(p, 0) + 1
        reach[p] = max((x for x in (reach.get(p), d) if x is not None), default=None)
        want.append((h, number[p]))
    for chunk in ("week", "year"):
        got = trajectories.stitch_encounters(df, chunk=chunk).select("hospitalization_id", "episode").collect()
        assert sorted(map(tuple, got)) == sorted(want)
