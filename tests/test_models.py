import math

import numpy as np
import pytest

from cohortspark.operators import models


def irls(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        w = mu * (1 - mu)
        beta = beta + np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    cov = np.linalg.inv(x.T @ ((mu * (1 - mu))[:, None] * x))
    deviance = -2 * np.sum(np.where(y == 1, np.log(mu), np.log(1 - mu)))
    return beta, np.sqrt(np.diag(cov)), deviance


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 1500
    age, group, year = rng.integers(20, 80, n), rng.choice(["a", "b", "c"], n), rng.integers(1995, 2001, n)
    eta = -2 + 0.03 * age + 0.8 * (group == "b")
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    los = 3 + 0.1 * age - 2.0 * (group == "c") + rng.normal(size=n)
    rows = [
        (int(a), str(g), int(t), int(o), float(s), 7.0, float(2 * a + 1))
        for a, g, t, o, s in zip(age, group, year, y, los)
    ]
    rows += [(30, "a", 1999, None, None, 7.0, 61.0), (None, "b", 1999, 1, 2.0, 7.0, 1.0)]
    df = spark.createDataFrame(
        rows, "age int, g string, year int, y int, los double, constant double, twice double"
    )
    x = np.column_stack([np.ones(n), age, year, group == "b", group == "c"]).astype(float)
    return df, x, y, los


def test_logistic_matches_dense_fit(data):
    df, x, y, _ = data
    fit = models.fit_logistic(df, "y", ["age", "constant", "year", "twice"], ["g"])
    beta, error, _ = irls(x, y)
    assert fit.aliased == ["constant", "twice"] and fit.n == len(y) and fit.n_events == y.sum()
    rows = {r[0]: r for r in fit.rows}
    assert list(rows) == ["(Intercept)", "age", "year", "gb", "gc"]
    for i, term in enumerate(rows):
        assert rows[term][1] == pytest.approx(beta[i], rel=1e-5)
        assert rows[term][2] == pytest.approx(error[i], rel=1e-5)
        assert rows[term][5] == pytest.approx(beta[i] - 1.959964 * error[i], rel=1e-4)


def test_profile_limits_raise_the_deviance_by_the_quantile(data):
    df, x, y, _ = data
    fit = models.fit_logistic(df, "y", ["age"], ["g"], ci="profile", profile_terms=["age"])
    x = x[:, [0, 1, 3, 4]]
    _, _, best = irls(x, y)
    low, high = next((r[5], r[6]) for r in fit.rows if r[0] == "age")
    for bound in (low, high):
        others, offset = x[:, [0, 2, 3]], bound * x[:, 1]
        beta = np.zeros(3)
        for _ in range(60):
            mu = 1 / (1 + np.exp(-(others @ beta + offset)))
            w = mu * (1 - mu)
            beta = beta + np.linalg.solve(others.T @ (w[:, None] * others), others.T @ (y - mu))
        mu = 1 / (1 + np.exp(-(others @ beta + offset)))
        deviance = -2 * np.sum(np.where(y == 1, np.log(mu), np.log(1 - mu)))
        assert deviance - best == pytest.approx(3.841459, rel=1e-3)


def test_fitted_probabilities_satisfy_the_score_equation(data):
    from pyspark.sql import functions as F

    df, _, _, _ = data
    fit = models.fit_logistic(df, "y", ["age"], ["g"])
    cases = df.dropna(subset=["y", "age"])
    row = cases.agg(F.sum(F.col("y") - fit.probability()), F.sum(F.col("age") * (F.col("y") - fit.probability()))).first()
    assert abs(row[0]) < 1e-6 and abs(row[1]) < 1e-4


def test_linear_matches_dense_fit(data):
    df, x, _, los = data
    fit = models.fit_linear(df, "los", ["age", "year"], ["g"])
    beta, rss, *_ = np.linalg.lstsq(x, los, rcond=None)
    n, p = x.shape
    assert fit.n == n + 0
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (n - p))
    q = models.t_quantile(0.975, n - p)
    for row, b, s in zip(fit.rows, beta, error):
        assert row[1] == pytest.approx(b, rel=1e-5, abs=1e-7)
        assert row[2] == pytest.approx(s, rel=1e-4)
        assert row[5] == pytest.approx(b - q * s, rel=1e-4, abs=1e-6)


def test_t_distribution():
    assert models.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert models.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    for t, df in ((2.0, 30), (1.3, 7), (4.0, 500)):
        x = np.linspace(t, t + 400, 4_000_001)
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        area = np.trapezoid(scale * (1 + x * x / df) ** (-(df + 1) / 2), x)
        assert models._t_tail(t, df) == pytest.approx(area, rel=1e-5)


def test_too_few_rows_give_no_fit(data, spark):
    df, *_ = data
    assert models.fit_logistic(df, "y", ["age"], min_rows=10**6) is None
    assert models.fit_logistic(df, "y", ["age"], min_events=10**6) is None
    assert models.tidy(spark, [(None, "y", "age")], [True]).count() == 0
    assert models._exp(1e4) == math.inf


def test_profile_limits_of_every_term(data):
    from pyspark.sql import functions as F

    df, x, y, _ = data
    fit = models.fit_logistic(df.withColumn("year", F.col("year") - 1998), "y", ["age", "year"], ["g"], ci="profile")
    x = x - np.array([0, 0, 1998, 0, 0])
    full, _, best = irls(x, y)
    names = ["(Intercept)", "age", "year", "gb", "gc"]
    assert [r[0] for r in fit.rows] == names and fit.converged and set(fit.ci_methods.values()) == {"profile"}
    for i, row in enumerate(fit.rows):
        for bound in row[5:7]:
            others, offset, beta = np.delete(x, i, axis=1), bound * x[:, i], np.delete(full, i)
            for _ in range(60):
                mu = 1 / (1 + np.exp(-(others @ beta + offset)))
                beta = beta + np.linalg.solve(others.T @ ((mu * (1 - mu))[:, None] * others), others.T @ (y - mu))
            mu = 1 / (1 + np.exp(-(others @ beta + offset)))
            deviance = -2 * np.sum(np.where(y == 1, np.log(mu), np.log(1 - mu)))
            assert deviance - best == pytest.approx(3.841459, rel=1e-3), names[i]


def test_separated_data_are_told(spark):
    df = spark.createDataFrame([(float(i), int(i >= 20)) for i in range(40)], "x double, y int")
    for ci in ("wald", "profile"):
        fit = models.fit_logistic(df, "y", ["x"], ci=ci)
        assert not fit.converged and all(r[5:] == (None, None) for r in fit.rows) and set(fit.ci_methods.values()) == {"none"}
    rows = models.tidy(spark, [(fit, "y", "x")], [True]).collect()
    assert all(r["conf.low"] is None and r.converged is False for r in rows)


def test_saturated_linear_models(spark):
    rng = np.random.default_rng(3)
    for levels in ("abc", "ab"):
        group = [levels[i % len(levels)] for i in range(180)]
        y = [2.0 + ord(g) + float(e) for g, e in zip(group, rng.normal(size=180), strict=True)]
        df = spark.createDataFrame(list(zip(group, y, strict=True)), "g string, y double")
        fit = models.fit_linear(df, "y", [], ["g"])
        x = np.column_stack([np.ones(180), *[[float(g == v) for g in group] for v in levels[1:]]])
        beta, rss, *_ = np.linalg.lstsq(x, np.array(y), rcond=None)
        error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (180 - len(levels)))
        assert [r[1] for r in fit.rows] == pytest.approx(list(beta)) and [r[2] for r in fit.rows] == pytest.approx(list(error))
    exact = models.fit_linear(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double"), "y", ["x"])
    assert exact.rows[1][1] == pytest.approx(2.0) and exact.rows[1][2] is None


def test_two_thousand_levels(spark):
    rng = np.random.default_rng(8)
    rows = [(f"l{i:04d}", int(y)) for i in range(2000) for y in [0, 1, *rng.integers(0, 2, 4)]]
    df = spark.createDataFrame(rows, "g string, y int")
    fit = models.fit_logistic(df, "y", [], ["g"])
    assert len(fit.rows) == 2000 and fit.converged
    by_level = {}
    for g, y in rows:
        by_level.setdefault(g, []).append(y)
    odds = {g: math.log(sum(v) / (len(v) - sum(v))) for g, v in by_level.items()}
    for term, estimate, *_ in (fit.rows[0], fit.rows[1], fit.rows[-1]):
        expected = odds["l0000"] if term == models.INTERCEPT else odds[term[1:]] - odds["l0000"]
        assert estimate == pytest.approx(expected, abs=1e-6)
