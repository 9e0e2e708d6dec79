import random

import numpy as np
import pytest

from cohortspark.operators import quantiles, summaries


def ntile_by_hand(rows, n):
    """rows of (id, value): {id: tile}"""
    order = sorted((v, i) for i, v in rows if v is not None)
    size, extra = divmod(len(order), n)
    out, place = {}, 0
    for tile in range(1, n + 1):
        for _ in range(size + (tile <= extra)):
            if place < len(order):
                out[order[place][1]] = tile
                place += 1
    return out


@pytest.mark.parametrize("size, distinct", [(0, 1), (2, 5), (3, 1), (11, 3), (501, 4), (30000, 7), (30000, 10**6)])
def test_ntiles_match_a_full_sort(spark, size, distinct):
    rng = random.Random(size + distinct)
    rows = [
        (i * 7 - 50, None if rng.random() < 0.1 else float(0 if rng.random() < 0.4 else rng.randrange(distinct)))
        for i in range(size)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(3)
    want = ntile_by_hand(rows, 4)
    got = {r.id: r.q for r in quantiles.add_ntiles(df, {"q": "v"}, "id").collect()}
    assert got == {i: want.get(i) for i, _ in rows}


def test_ntiles_with_text_ids_are_balanced_and_ordered(spark):
    rows = [(f"H{i:05d}", float(i % 3)) for i in range(10001)]
    got = quantiles.add_ntiles(spark.createDataFrame(rows, "id string, v double"), {"q": "v"}, "id").collect()
    sizes = sorted(sum(r.q == t for r in got) for t in (1, 2, 3, 4))
    assert sizes == [2500, 2500, 2500, 2501]
    assert all(max(r.v for r in got if r.q == t) <= min(r.v for r in got if r.q == t + 1) for t in (1, 2, 3))


def test_ntiles_with_text_ids_in_their_true_order(spark):
    rng = random.Random(4)
    ids = {"", "a", "a\x00", "aaaaaaa", "aaaaaaab", "aaaaaaa\x00", "é", "éa", "日本語の名前", "Z" * 40, "Z" * 40 + "a"}
    while len(ids) < 400:
        ids.add("".join(rng.choices("ab\x00é9", k=rng.randint(1, 20))))
    rows = [(i, float(rng.choice([1, 1, 1, 1, 2]))) for i in sorted(ids, key=lambda _: rng.random())]
    got = {r.id: r.q for r in quantiles.add_ntiles(spark.createDataFrame(rows, "id string, v double"), {"q": "v"}, "id", 5).collect()}
    assert got == {i.decode(): t for i, t in ntile_by_hand([(i.encode(), v) for i, v in rows], 5).items()}


@pytest.mark.parametrize("size, kind", [(1, "ties"), (5, "ties"), (20000, "ties"), (20000, "normal"), (20000, "heavy")])
def test_percentiles_match_numpy(spark, size, kind):
    rng = np.random.default_rng(size)
    data = {
        "ties": rng.integers(0, 9, size).astype(float),
        "normal": rng.normal(size=size),
        "heavy": np.where(rng.random(size) < 0.4, 3.25, rng.lognormal(3, 4, size)),
    }[kind]
    group = [None if i % 3 == 0 else "g" for i in range(size)]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(group, data)], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r.p for r in quantiles.exact_percentiles(df, ["x"], probs, ["g"]).collect()}
    for g in set(group):
        own = [v for h, v in zip(group, data) if h == g]
        assert got[g] == pytest.approx(list(np.quantile(own, probs)), rel=1e-12, abs=1e-12)


def test_order_statistics_of_large_integers(spark):
    from pyspark.sql import functions as F

    base = 2**62
    rows = [(1, base + 3 * i) for i in range(20000)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    got = quantiles.order_statistics(df, ["k"], "v", lambda n: F.array(F.struct((n - 5).alias("rank")))).collect()
    assert [r.v for r in got] == [base + 3 * 19995]


def test_continuous_table_with_empty_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), ("c", 5.0)], "g string, x double")
    got = {r.g: r for r in summaries.continuous_table(df, ["x"], ["g"]).collect()}
    assert (got["a"].n_nonmissing, got["a"].median, got["a"].p25, got["a"].p75) == (3, 2.0, 1.5, 3.0)
    assert got["b"].n_nonmissing == 0 and got["b"].median is None and got["b"].mean is None
    assert got["c"].sd is None and got["c"].median == 5.0


def test_binary_mode_and_small_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 0), ("b", 1)], "g string, x int")
    got = {r.g: (r.n, r.events, r.pct) for r in summaries.binary_table(df, ["x"], ["g"]).collect()}
    assert got["a"] == (3, 1, pytest.approx(100 / 3)) and got["b"] == (1, 1, 100.0)
    ties = spark.createDataFrame([("y",), ("x",), ("y",), ("x",), (None,)], "v string")
    assert summaries.mode_value(ties, "v").first().mode_value == "x"
    cells = summaries.suppress_small_cells(spark.createDataFrame([(9, 1), (10, 2)], "n int, d int"), "n", ["d"])
    assert sorted(cells.collect(), key=str) == sorted([(None, None), (10, 2)], key=str)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, float("nan")), (5, None)], "id int, x double")
    row = summaries.continuous_table(df, ["x"]).first()
    assert (row.n_nonmissing, row["mean"], row["min"], row["max"], row.median, row.p75) == (3, 2.0, 1.0, 3.0, 2.0, 2.5)
    assert {r.id: r.q for r in quantiles.add_ntiles(df, {"q": "x"}, "id", 3).collect()} == {1: 1, 2: 2, 3: 3, 4: None, 5: None}
