"""Seasonal-naive, Holt-Winters and differenced autoregressive forecasts."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wellspan.functions.stats import ratio
from wellspan.session import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def seasonal_naive(
    parts: DataFrame, keys: list[str], t: str, steps: list[int], freq: str = "month"
) -> DataFrame:
    """Last trend value plus the latest seasonal value of the same calendar month.

    ``parts``: keys, date, ``trend``, ``seasonal`` of a decomposition.
    """
    last = parts.groupBy(*keys).agg(
        F.max(t).alias("last_train"),
        F.max_by("trend", F.when(F.col("trend").isNotNull(), F.col(t))).alias("trend_last"),
    )
    season = parts.groupBy(*keys, F.month(t).alias("moy")).agg(
        F.max_by("seasonal", F.when(F.col("seasonal").isNotNull(), F.col(t))).alias("season_last")
    )
    step = F.explode(F.array(*[F.lit(s) for s in steps])).alias("step")
    ahead = last.select(*keys, "last_train", "trend_last", step)
    ds = F.expr("add_months(last_train, step)") if freq == "month" else F.expr("date_add(last_train, step)")
    ahead = ahead.withColumn("ds", ds).withColumn("moy", F.month("ds"))
    return ahead.join(season, [*keys, "moy"], "left").select(
        *keys, "step", "ds", (F.col("trend_last") + F.col("season_last")).alias("yhat")
    )


def _holt_winters(y: np.ndarray, period: int, horizon: int, grid: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Best parameters, their RMSE and the forecast. ``grid`` rows: alpha, beta, gamma, phi."""
    alpha, beta, gamma, phi = grid.T
    m1, m2 = y[:period].mean(), y[period:2 * period].mean()
    level, trend = np.full(len(grid), m1), np.full(len(grid), (m2 - m1) / period)
    season = np.tile(y[:period] - m1, (len(grid), 1))
    sse, rest = np.zeros(len(grid)), y[period:]
    for i, value in enumerate(rest):
        at = i % period
        s, damped = season[:, at].copy(), phi * trend
        sse += (value - (level + damped + s)) ** 2
        new = alpha * (value - s) + (1 - alpha) * (level + damped)
        season[:, at] = gamma * (value - level - damped) + (1 - gamma) * s
        trend = beta * (new - level) + (1 - beta) * damped
        level = new
    best = np.lexsort((phi, gamma, beta, alpha, sse))[0]
    steps = np.arange(1, horizon + 1)
    damp = np.cumsum(phi[best] ** steps)
    ahead = level[best] + damp * trend[best] + season[best, (len(rest) + steps - 1) % period]
    return grid[best], float(np.sqrt(sse[best] / len(rest))), ahead


def holt_winters_grid(
    df: DataFrame, keys: list[str], t: str, column: str, period: int, horizon: int,
    alphas: list[float], betas: list[float], gammas: list[float], phis: list[float],
) -> DataFrame:
    """Damped additive Holt-Winters over a parameter grid, the best one per station kept.

    The recursion is sequential in time, so a task folds one station's dense daily series (bounded
    by the calendar) once, with all grid points as a vector and the season as a ring. The start
    state is the mean of the first cycle, the mean slope between the first two cycles, and the first
    cycle's offsets; the fold runs from the second cycle on. A station shorter than two cycles has no
    start state: its forecast is NULL and ``reason`` says so.
    """
    series = df.groupBy(*keys).agg(
        F.max(F.when(F.col(column).isNotNull(), F.col(t))).alias("last_train"),
        F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(t).alias("d"), F.col(column).cast("double").alias("y"))))).alias("_s"),
    ).select(*keys, "last_train", F.col("_s.y").alias("_y"))
    grid = np.array(list(product(alphas, betas, gammas, phis)), float)
    kinds = [df.schema[c] for c in keys]
    schema = T.StructType(kinds + [T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", "gamma", "phi", "fit_rmse")] + [
        T.StructField("step", T.IntegerType()), T.StructField("ds", T.DateType()), T.StructField("yhat", T.DoubleType()),
        T.StructField("reason", T.StringType())])
    by = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                y = np.array(batch.column("_y")[i].as_py() or [], float)
                last = batch.column("last_train")[i].as_py()
                if len(y) >= 2 * period:
                    params, rmse, ahead = _holt_winters(y, period, horizon, grid)
                    numbers, reason = [*params, rmse], None
                else:
                    ahead, numbers = [None] * horizon, [None] * 5
                    reason = f"{len(y)} values, two cycles have {2 * period}"
                days = [None if last is None else last + dt.timedelta(days=s) for s in range(1, horizon + 1)]
                head = [batch.column(c).take(pa.array([i] * horizon)) for c in by]
                yield pa.RecordBatch.from_arrays(
                    head + [pa.array([x] * horizon, pa.float64()) for x in numbers] + [
                        pa.array(range(1, horizon + 1), pa.int32()), pa.array(days, pa.date32()), pa.array(ahead, pa.float64()),
                        pa.array([reason] * horizon, pa.string())],
                    [*by, "alpha", "beta", "gamma", "phi", "fit_rmse", "step", "ds", "yhat", "reason"])

    return spread(series, *keys).mapInArrow(run, schema)


def ar_diff_forecast(
    parts: DataFrame, keys: list[str], t: str, horizon: int, period: int
) -> DataFrame:
    """Deseasonalise, AR(1) on first differences without intercept, season added back.

    ``parts``: output of the robust decomposition. The forecast of the differences is geometric,
    so the level has the closed form ``last + d * phi (1 - phi^h) / (1 - phi)``.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    flat = parts.withColumn("_a", F.col("y") - F.col("seasonal"))
    flat = flat.withColumn("_d", F.col("_a") - F.lag("_a").over(w))
    flat = flat.withColumn("_d1", F.lag("_d").over(w))
    fit = flat.groupBy(*keys).agg(
        ratio(F.sum(F.col("_d") * F.col("_d1")), F.sum(F.when(F.col("_d").isNotNull(), F.col("_d1") * F.col("_d1")))).alias("phi"),
        F.max(t).alias("last_train"),
        F.max_by("_a", t).alias("a_last"),
        F.max_by("_d", t).alias("d_last"),
        F.max_by("pos", t).alias("pos_last"),
    )
    season = parts.groupBy(*keys, "pos").agg(F.max_by("seasonal", t).alias("season"))
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ahead = fit.select("*", step).withColumn("pos", F.pmod(F.col("pos_last") + F.col("step"), F.lit(period)))
    phi = F.col("phi")
    rise = F.when(phi == 1, F.col("step").cast("double")).otherwise(
        ratio(phi * (1 - F.pow(phi, F.col("step"))), 1 - phi)
    )
    return ahead.join(season, [*keys, "pos"], "left").select(
        *keys, "phi", "step", F.expr("date_add(last_train, step)").alias("ds"),
        (F.col("a_last") + F.col("d_last") * rise + F.coalesce("season", F.lit(0.0))).alias("yhat"),
    )
