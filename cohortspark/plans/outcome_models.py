"""Adjusted outcome models of the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Fit, explicit_missing, fit_linear, fit_logistic, tidy
from .burden import with_exposure

EXPOSURE = "primary_exposure"
NUMERIC = [EXPOSURE, "age_at_admission", "icu_year"]
FACTORS = ["cancer_type_broad", "admission_type_category"]
LOGISTIC_OUTCOMES = ["hospital_mortality", "any_imv", "any_vasopressor", "any_crrt"]
LINEAR_OUTCOMES = ["hospital_los_days", "icu_los_days"]
PRIMARY_COLUMNS = ["outcome", "term", "estimate", "conf.low", "conf.high", "p.value", "model_n"]


def model_data(data: DataFrame) -> DataFrame:
    """Exposure flag, factors with missing as a level, numeric age and year.

    Note that ventilation, vasopressors and renal replacement are outcomes
    here and also part of the exposure's definition.
    """
    return with_exposure(data).withColumns(
        {
            **{name: explicit_missing(F.col(name)) for name in FACTORS},
            "age_at_admission": F.col("age_at_admission").cast("double"),
            "icu_year": F.col("icu_year").cast("double"),
        }
    )


def logistic_model(data: DataFrame, outcome: str, ci: str = "profile") -> Fit | None:
    return fit_logistic(model_data(data), outcome, NUMERIC, FACTORS, ci=ci)


def linear_model(data: DataFrame, outcome: str) -> Fit | None:
    return fit_linear(model_data(data), outcome, NUMERIC, FACTORS)


def trend_model(data: DataFrame, outcome: str = "probable_checkpoint_irae_icu") -> Fit | None:
    """Calendar year as a continuous term."""
    return fit_logistic(model_data(data), outcome, ["icu_year"], ci="profile")


def all_models(data: DataFrame, ci: str = "profile") -> DataFrame:
    """Every term of every model."""
    fits = [(logistic_model(data, o, ci), o, EXPOSURE) for o in LOGISTIC_OUTCOMES]
    fits += [(linear_model(data, o), o, EXPOSURE) for o in LINEAR_OUTCOMES]
    odds = [True] * len(LOGISTIC_OUTCOMES) + [False] * len(LINEAR_OUTCOMES)
    return tidy(data.sparkSession, fits, odds)


def model_results(models: DataFrame) -> DataFrame:
    """The exposure rows of all models."""
    return models.filter(F.col("term") == EXPOSURE).select(*[F.col(f"`{c}`") for c in PRIMARY_COLUMNS])
