"""Lagged driver-to-response correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.functions.stats import corr_safe
from wellspan.operators.calendar import monthly
from wellspan.operators.events import arg_extreme


def cross_correlation(
    pairs: DataFrame, keys: list[str], t: str, driver: str, response: str, maxlag: int = 12
) -> DataFrame:
    """r(driver at t, response at t+L) for L = 0..maxlag over aligned rows.

    All leads are columns of one window and all correlations one aggregate; there is no self-join.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    rows = pairs.where(F.col(driver).isNotNull() & F.col(response).isNotNull())
    led = rows.select(
        *keys, F.col(driver).alias("_d"),
        *[F.lead(response, lag).over(w).alias(f"_r{lag}") for lag in range(maxlag + 1)],
    )
    rs = led.groupBy(*keys).agg(
        *[corr_safe(F.col("_d"), F.col(f"_r{lag}")).alias(f"r{lag}") for lag in range(maxlag + 1)]
    )
    profile = F.array(*[
        F.struct(F.lit(lag).alias("lag"), F.col(f"r{lag}").alias("r")) for lag in range(maxlag + 1)
    ])
    return rs.select(*keys, F.inline(profile))


def best_lag(profile: DataFrame, keys: list[str], by_abs: bool = False) -> DataFrame:
    """Lag of the largest r (signed unless ``by_abs``), the smaller lag on ties."""
    order = F.abs("r") if by_abs else F.col("r")
    valid = profile.where(F.col("r").isNotNull())
    return arg_extreme(valid, keys, [order.desc(), F.col("lag")])


def index_driver_pairs(panel: DataFrame, keys: list[str], response: str) -> DataFrame:
    """Long panel to (driver, response) rows: every other index against ``response``.

    The response reaches the other rows of its month by a window, not by a self-join. A panel with a
    ``scale`` pairs equal scales and keeps the column.
    """
    keys = [*keys, "scale"] if "scale" in panel.columns else keys
    month = Window.partitionBy(*keys, "month")
    target = F.max(F.when(F.col("index_name") == response, F.col("z"))).over(month)
    return panel.withColumn("response", target).where(F.col("index_name") != response).select(
        *keys, F.col("index_name").alias("driver"), "month", F.col("z").alias("value"), "response"
    )


def raw_driver_pairs(
    df: DataFrame, keys: list[str], t: str, response: str, drivers: dict[str, str]
) -> DataFrame:
    """Raw daily drivers to monthly (driver, response) rows by each driver's own aggregate."""
    m = monthly(df, keys, t, {response: "mean", **drivers})
    rows = [F.struct(F.lit(d).alias("driver"), F.col(d).alias("value")) for d in drivers]
    return m.select(*keys, "month", F.col(response).alias("response"), F.inline(F.array(*rows)))
