"""Modelling frames: lagged regressors, lead targets and holdout splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan.operators.calendar import split_tail
from wellspan.operators.rolling import extend_and_lag, lead_targets


def lagged_frame(
    df: DataFrame, keys: list[str], t: str, y: str, columns: list[str], h: int, freq: str = "day"
) -> DataFrame:
    """``ds``, ``y`` and ``<column>_lag<h>`` on the calendar extended by ``h`` periods."""
    ext = extend_and_lag(df.select(*keys, t, y, *[c for c in columns if c != y]), keys, t, columns, h, freq)
    return ext.select(*keys, F.col(t).alias("ds"), F.col(y).alias("y"), *lag_names(columns, h))


def lag_names(columns: list[str], h: int) -> list[str]:
    return [f"{c}_lag{h}" for c in columns]


def train_frame(df: DataFrame, keys: list[str], t: str, y: str, columns: list[str], h: int, freq: str = "day") -> DataFrame:
    """Rows where the target and every lagged regressor are known."""
    return lagged_frame(df, keys, t, y, columns, h, freq).dropna(subset=["y", *lag_names(columns, h)])


def future_frame(df: DataFrame, keys: list[str], t: str, y: str, columns: list[str], h: int, freq: str = "day") -> DataFrame:
    """Rows where every lagged regressor is known: history plus ``h`` periods."""
    return lagged_frame(df, keys, t, y, columns, h, freq).dropna(subset=lag_names(columns, h))


def holdout(df: DataFrame, keys: list[str], t: str, columns: list[str], n_test: int = 30) -> DataFrame:
    """Complete rows, the last ``n_test`` of each station tagged ``test``."""
    rows = df.select(*keys, t, *columns).dropna(subset=columns)
    return split_tail(rows, keys, t, n_test)


def lead_frame(
    df: DataFrame, keys: list[str], t: str, target: str, steps: list[int],
    skip: int = 7, take: int = 3, purge: bool = True,
) -> DataFrame:
    """Supervised frame with lead targets and a fixed test slice near the end.

    With ``purge`` the last training rows, whose lead targets reach into the test slice, are
    left out.
    """
    led = lead_targets(df, keys, t, target, steps)
    return split_tail(led, keys, t, skip, take, purge=max(steps) if purge else 0)


def feature_target(df: DataFrame, features: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    return df.select(*features), df.select(target)


def split_forecast(forecast: DataFrame, last: DataFrame, keys: list[str], ds: str = "ds") -> DataFrame:
    """Rows tagged as history or future relative to the last training date."""
    return forecast.join(last, keys).withColumn(
        "part", F.when(F.col(ds) > F.col("last_train"), F.lit("future")).otherwise(F.lit("history"))
    )
