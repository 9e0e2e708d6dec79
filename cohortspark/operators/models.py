"""Logistic and linear regression on data counted per covariate pattern.

Rows with equal covariates are counted before fitting. Each step of the solver is one pass over the stored
patterns in which every task sums its share of the score and the information (the nonzero entries only), also
for many constrained fits at once, as profile limits need. Only the design's levels and terms-by-terms sums
reach the driver, where the small systems are solved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import materialize

INTERCEPT = "(Intercept)"
STEPS = 40
SEARCHES = 25
TOLERANCE = 1e-14
CERTAIN = 1e-8  # a fitted probability this close to 0 or 1 shows separated data
TIDY_SCHEMA = (
    "term string, estimate double, `std.error` double, statistic double, `p.value` double, "
    "`conf.low` double, `conf.high` double"
)


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*dict.fromkeys(columns)).dropna()


def explicit_missing(col: Column, level: str = "missing") -> Column:
    """Missing factor values become a level of their own."""
    return F.coalesce(col.cast("string"), F.lit(level))


@dataclass
class Design:
    """Model terms as column expressions over the input columns."""

    numeric: list[str]
    factors: list[str]
    levels: dict[str, list[str]]
    terms: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.terms = {name: F.col(name).cast("double") for name in self.numeric}
        for factor in self.factors:
            # The first level in code-point order is the reference.
            for level in self.levels[factor][1:]:
                self.terms[factor + level] = (F.col(factor).cast("string") == level).cast("double")


@dataclass
class Fit:
    coefficients: dict[str, float]
    rows: list[tuple]
    n: int
    n_events: float | None
    aliased: list[str]
    design: Design
    converged: bool = True
    ci_methods: dict[str, str] = field(default_factory=dict)

    def linear_predictor(self, replace: dict[str, Column] | None = None) -> Column:
        """Fitted linear predictor over the input columns, with some terms replaced."""
        terms = {**self.design.terms, **(replace or {})}
        total = F.lit(self.coefficients[INTERCEPT])
        for name, beta in self.coefficients.items():
            if name != INTERCEPT:
                total = total + F.lit(beta) * terms[name]
        return total

    def probability(self, replace: dict[str, Column] | None = None) -> Column:
        return 1 / (1 + F.exp(-self.linear_predictor(replace)))


def _levels(patterns: DataFrame, factors: list[str]) -> dict[str, list[str]]:
    """Every factor's levels in code-point order; they are as many as the design has columns."""
    return {f: sorted(row[0] for row in patterns.select(F.col(f).cast("string")).distinct().collect()) for f in factors}


class Matrix:
    """The standardised design of a stored table of patterns, and sums over it."""

    def __init__(self, patterns: DataFrame, design: Design):
        self.design, self.numeric = design, design.numeric
        self.columns = [*(F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(design.numeric)),
                        *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(design.factors))]
        self.patterns = patterns.select(*self.columns, "w", "y")
        w, total = F.col("w"), F.sum("w")
        means = [F.sum(w * F.col(f"n{i}")) / total for i in range(len(design.numeric))]
        row = self.patterns.agg(*means, F.lit(0)).first()
        center = [row[i] for i in range(len(design.numeric))]
        spread = [F.sqrt(F.sum(w * (F.col(f"n{i}") - F.lit(center[i])) ** 2) / total) for i in range(len(center))]
        row = self.patterns.agg(*spread, F.lit(0)).first()
        self.center, self.scale = np.array(center, float), np.array([row[i] or 1.0 for i in range(len(center))], float)
        self.places = {f"f{i}": {level: k for k, level in enumerate(design.levels[f])} for i, f in enumerate(design.factors)}
        self.kept = list(range(1 + len(design.terms)))

    def sums(self, passes: list[tuple[np.ndarray, bool]]) -> list[dict]:
        """For each (coefficients, logistic): score, information, deviance or squared error, and certain rows."""
        numeric, center, scale, places, kept = len(self.numeric), self.center, self.scale, self.places, np.array(self.kept)
        width = 1 + len(self.design.terms)
        chunk = max(16, 2_000_000 // width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[dict | None] = [None] * len(passes)
            for batch in batches:
                for start in range(0, batch.num_rows, chunk):
                    part = batch.slice(start, chunk)
                    x = np.zeros((part.num_rows, width))
                    x[:, 0] = 1
                    for i in range(numeric):
                        x[:, 1 + i] = (part.column(i).to_numpy(zero_copy_only=False) - center[i]) / scale[i]
                    at = 1 + numeric
                    for i, place in enumerate(places.values()):
                        codes = np.array([place[v] for v in part.column(numeric + i).to_pylist()])
                        rows = np.nonzero(codes)[0]
                        x[rows, at + codes[rows] - 1] = 1
                        at += len(place) - 1
                    x = x[:, kept]
                    w, y = (part.column(part.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
                    for k, (beta, logistic) in enumerate(passes):
                        eta = x @ beta
                        if logistic:
                            mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                            weight = w * mu * (1 - mu)
                            loss = 2 * (w * (np.logaddexp(0, eta) - y * eta)).sum()
                            certain = w[(mu < CERTAIN) | (mu > 1 - CERTAIN)].sum()
                        else:
                            mu, weight, certain = eta, w, 0.0
                            loss = (w * (y - mu) ** 2).sum()
                        own = np.concatenate([[loss, certain], x.T @ (w * (y - mu)), (x.T @ (weight[:, None] * x)).ravel()])
                        found[k] = own if found[k] is None else found[k] + own
            for k, own in enumerate(found):
                if own is not None:
                    at = np.nonzero(own)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64)), pa.array(own[at])], names=["k", "i", "v"])

        rows = self.patterns.mapInArrow(run, "k int, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
        p = len(self.kept)
        out = []
        for k in range(len(passes)):
            own = rows[rows["k"] == k]
            flat = np.zeros(2 + p + p * p)
            flat[own["i"]] = own["v"]
            out.append({"loss": flat[0], "certain": flat[1], "score": flat[2 : 2 + p], "info": flat[2 + p :].reshape(p, p)})
        return out

    def drop_aliased(self) -> list[str]:
        """Leave out terms that are linear combinations of the intercept and earlier terms; gives their names."""
        names = list(self.design.terms)
        gram = self.sums([(np.zeros(len(self.kept)), False)])[0]["info"]
        rest, kept = gram.copy(), []
        for i in range(len(gram)):  # elimination in the order of the terms: what is left of a term beside the kept ones
            if i and rest[i, i] <= 1e-9 * max(gram[i, i], 1e-300):
                continue
            kept.append(i)
            rest[i + 1 :, i + 1 :] -= np.outer(rest[i + 1 :, i] / rest[i, i], rest[i, i + 1 :])
        aliased = [names[i - 1] for i in range(1, len(gram)) if i not in kept]
        self.kept = kept
        return aliased

    def terms(self) -> list[str]:
        names = [INTERCEPT, *self.design.terms]
        return [names[i] for i in self.kept]

    def unscale(self) -> np.ndarray:
        """The matrix that takes standardised coefficients to those of the terms as given."""
        t = np.eye(len(self.kept))
        for k, i in enumerate(self.kept):
            if 1 <= i <= len(self.numeric):
                t[k, k] = 1 / self.scale[i - 1]
                t[0, k] = -self.center[i - 1] / self.scale[i - 1]
        return t


def _newton(matrix: Matrix, starts: list[np.ndarray], fixed: list[np.ndarray | None]) -> list[tuple[np.ndarray, dict, bool]]:
    """Maximum likelihood from the starts, each along the directions that keep ``fixed @ beta``; (beta, sums, converged)."""
    beta, best = [b.copy() for b in starts], [None] * len(starts)
    step = [np.zeros_like(b) for b in starts]
    state: list[bool | None] = [None] * len(starts)
    for _ in range(STEPS):
        active = [k for k, s in enumerate(state) if s is None]
        if not active:
            break
        for k, found in zip(active, matrix.sums([(beta[k] + step[k], True) for k in active]), strict=True):
            if best[k] is not None and not found["loss"] <= best[k]["loss"] + 1e-7 * (1 + abs(best[k]["loss"])):
                step[k] /= 2
                if np.abs(step[k]).max() < 1e-12:
                    state[k] = False
                continue
            beta[k], best[k] = beta[k] + step[k], found
            p, c = len(beta[k]), fixed[k]
            system, right = found["info"], found["score"]
            if c is not None:
                system = np.block([[system, c[:, None]], [c[None, :], np.zeros((1, 1))]])
                right = np.append(right, 0.0)
            try:
                step[k] = np.linalg.solve(system, right)[:p]
            except np.linalg.LinAlgError:
                state[k] = False
                continue
            if abs(step[k] @ found["score"]) < TOLERANCE:
                state[k] = not found["certain"]
                beta[k] = beta[k] + step[k]  # a last step, too small to be checked again
            elif found["certain"]:
                state[k] = False
    return [(b, f, bool(s)) for b, f, s in zip(beta, best, state, strict=True)]


def _profile(matrix: Matrix, beta: np.ndarray, sums: dict, wanted: list[np.ndarray], z: float) -> list[tuple[float | None, float | None]]:
    """Both values of each combination ``c @ beta`` at which the refitted deviance rises by z squared, else None.

    All refits of a round share their passes over the patterns. The signed root of the rise is nearly linear in
    the value, so a secant search starts from the Wald limit.
    """
    covariance = np.linalg.inv(sums["info"])
    searches = []
    for c in wanted:
        direction = covariance @ c
        error = math.sqrt(c @ direction)
        for target in (-z, z):
            searches.append({"c": c, "along": direction / (error * error), "target": target, "at": float(c @ beta), "x0": float(c @ beta), "r0": 0.0, "x1": float(c @ beta) + target * error, "beta": beta, "done": None})
    for _ in range(SEARCHES):
        active = [s for s in searches if s["done"] is None]
        if not active:
            break
        starts = [s["beta"] + s["along"] * (s["x1"] - s["c"] @ s["beta"]) for s in active]
        for s, (refit, found, converged) in zip(active, _newton(matrix, starts, [s["c"] for s in active]), strict=True):
            if not converged:
                s["done"] = False
                continue
            r1 = math.copysign(math.sqrt(max(found["loss"] - sums["loss"], 0.0)), s["x1"] - s["at"])
            s["beta"] = refit
            if abs(r1 - s["target"]) < 1e-6:
                s["done"] = True
            elif r1 == s["r0"]:
                s["done"] = False
            else:
                s["x0"], s["r0"], s["x1"] = s["x1"], r1, s["x1"] + (s["target"] - r1) * (s["x1"] - s["x0"]) / (r1 - s["r0"])
    values = [s["x1"] if s["done"] else None for s in searches]
    return list(zip(values[::2], values[1::2], strict=True))


def fit_logistic(
    df: DataFrame,
    outcome: str,
    numeric: list[str],
    factors: list[str] | None = None,
    ci: str = "wald",
    profile_terms: list[str] | None = None,
    level: float = 0.95,
    min_rows: int = 0,
    min_events: int = 0,
    store: Callable[[DataFrame], DataFrame] = materialize,
) -> Fit | None:
    """Binomial regression over complete cases; None below the minimum rows or events.

    Limits are Wald limits, or with ``ci='profile'`` profile-likelihood limits of every term (of ``profile_terms``
    only, if given; the others then have none). A fit that does not converge, as on separated data, says so and has
    no limits; a single limit that is not found is missing.
    """
    factors = factors or []
    cases = complete_cases(df, [outcome, *numeric, *factors])
    y = F.col(outcome).cast("double")
    patterns = store(
        cases.groupBy(*dict.fromkeys([*numeric, *factors])).agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg(y).alias("y"))
    )
    size = patterns.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("events")).first()
    n, events = int(size["n"] or 0), size["events"] or 0.0
    if n == 0 or n < min_rows or events < min_events:
        return None
    matrix = Matrix(patterns, Design(numeric, factors, _levels(patterns, factors)))
    aliased = matrix.drop_aliased()
    names = matrix.terms()
    start = np.zeros(len(names))
    beta, sums, converged = _newton(matrix, [start], [None])[0]
    unscale = matrix.unscale()
    values = unscale @ beta
    covariance = unscale @ np.linalg.pinv(sums["info"]) @ unscale.T
    errors = np.sqrt(np.diag(covariance))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    limits: dict[str, tuple] = dict.fromkeys(names, (None, None))
    methods = dict.fromkeys(names, "none")
    if converged and ci == "wald":
        limits = {t: (b - z * s, b + z * s) for t, b, s in zip(names, values.tolist(), errors.tolist(), strict=True)}
        methods = dict.fromkeys(names, "wald")
    elif converged:
        chosen = [t for t in names if profile_terms is None or t in profile_terms]
        limits |= dict(zip(chosen, _profile(matrix, beta, sums, [unscale[names.index(t)] for t in chosen], z), strict=True))
        methods |= dict.fromkeys(chosen, "profile")
    rows = []
    for t, b, s in zip(names, values.tolist(), errors.tolist(), strict=True):
        stat = b / s if s else float("nan")
        rows.append((t, b, s, stat, 2 * NormalDist().cdf(-abs(stat)), *limits[t]))
    return Fit(dict(zip(names, values.tolist(), strict=True)), rows, n, events, aliased, matrix.design, converged, methods)


def fit_linear(
    df: DataFrame,
    outcome: str,
    numeric: list[str],
    factors: list[str] | None = None,
    level: float = 0.95,
    store: Callable[[DataFrame], DataFrame] = materialize,
) -> Fit | None:
    """Least squares over complete cases, from per-pattern counts, means and squares.

    The coefficients and their covariance come from the weighted normal equations; the residual variance is the
    within-pattern and between-pattern squares by the free rows, so saturated designs have limits too.
    """
    factors = factors or []
    cases = complete_cases(df, [outcome, *numeric, *factors])
    y = F.col(outcome).cast("double")
    patterns = store(
        cases.groupBy(*dict.fromkeys([*numeric, *factors])).agg(
            F.count(F.lit(1)).cast("double").alias("w"), F.avg(y).alias("y"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("within"),
        )
    )
    size = patterns.agg(F.sum("w").alias("n"), F.sum("within").alias("within")).first()
    if not size["n"]:
        return None
    n = int(size["n"])
    matrix = Matrix(patterns, Design(numeric, factors, _levels(patterns, factors)))
    aliased = matrix.drop_aliased()
    names = matrix.terms()
    found = matrix.sums([(np.zeros(len(names)), False)])[0]
    beta = np.linalg.solve(found["info"], found["score"])
    for _ in range(2):  # one refinement takes up what the first solution lost in the last digits
        residual = matrix.sums([(beta, False)])[0]
        beta = beta + np.linalg.solve(found["info"], residual["score"])
    unscale, free = matrix.unscale(), n - len(names)
    values = (unscale @ beta).tolist()
    variance = (size["within"] + residual["loss"]) / free if free > 0 else float("nan")
    errors = np.sqrt(np.diag(unscale @ np.linalg.inv(found["info"]) @ unscale.T) * variance).tolist()
    q = t_quantile(0.5 + level / 2, free) if free > 0 else float("nan")
    rows = []
    for t, b, s in zip(names, values, errors, strict=True):
        if free > 0 and s > 0:
            rows.append((t, b, s, b / s, 2 * _t_tail(abs(b / s), free), b - q * s, b + q * s))
        else:
            rows.append((t, b, s if free > 0 else None, None, None, None, None))
    return Fit(dict(zip(names, values, strict=True)), rows, n, None, aliased, matrix.design, True, dict.fromkeys(names, "t"))


def _t_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0, from the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x in (0.0, 1.0):
        return x / 2
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a / 2
    return (1 - front * fraction(1 - x, b, a) / b) / 2


def t_quantile(prob: float, df: float) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_tail(mid, df) > 1 - prob else (low, mid)
    return (low + high) / 2


def _exp(x: float) -> float:
    return math.exp(x) if x < 709.0 else math.inf


def tidy(spark, fits: list[tuple[Fit | None, str, str]], exponentiate: list[bool]) -> DataFrame:
    """One row per term of each (fit, outcome, exposure), with how its limits were found; skipped fits give none."""
    rows = []
    for (fit, outcome, exposure), exp in zip(fits, exponentiate, strict=True):
        for term, b, s, stat, p, low, high in fit.rows if fit is not None else []:
            change = _exp if exp else float
            shown = [None if x is None else change(x) for x in (low, high)]
            rows.append((term, change(b), s, stat, p, *shown, outcome, exposure, fit.n, fit.converged, fit.ci_methods.get(term)))
    return spark.createDataFrame(rows, TIDY_SCHEMA + ", outcome string, exposure string, model_n bigint, converged boolean, ci_method string")
