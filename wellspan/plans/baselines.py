"""Baseline forecasts over rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.operators.folds import test_rows

MODELS = ("last_value", "seasonal_naive", "climatology")


def naive_backtest(dense: DataFrame, cutoffs: DataFrame, keys: list[str], h: int, z: float) -> DataFrame:
    """Last value, value of the same day a year before, and mean of earlier same-month days.

    ``dense``: keys, ``ds``, ``y``, one row per day. Each baseline is an equi-join; the climatology
    is a running mean over the earlier years of a calendar month, looked up one year back, so it
    never sees its own fold. The interval is ``z`` times the spread of the station's series up to the
    cutoff, a running aggregate read off there.
    """
    spread = F.stddev_samp("y").over(Window.partitionBy(*keys).orderBy("ds"))
    rows = test_rows(dense, cutoffs, keys, h)
    last = dense.select(*keys, F.col("ds").alias("cutoff"), F.col("y").alias("last_value"), spread.alias("_sd"))
    year_ago = dense.select(*keys, F.date_add("ds", 365).alias("ds"), F.col("y").alias("seasonal_naive"))
    sums = dense.groupBy(*keys, F.trunc("ds", "MM").alias("_month")).agg(
        F.sum("y").alias("_sum"), F.count("y").alias("_n")
    )
    w = Window.partitionBy(*keys, F.month("_month")).orderBy("_month").rowsBetween(Window.unboundedPreceding, 0)
    clim = sums.select(
        *keys, F.add_months("_month", 12).alias("_month"),
        (F.sum("_sum").over(w) / F.sum("_n").over(w)).alias("climatology"),
    )
    wide = (
        rows.join(last, [*keys, "cutoff"], "left")
        .join(year_ago, [*keys, "ds"], "left")
        .withColumn("_month", F.trunc("ds", "MM"))
        .join(clim, [*keys, "_month"], "left")
    )
    picks = [F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in MODELS]
    half = F.col("_sd") * F.lit(z)
    return wide.select(*keys, "cutoff", "ds", "horizon", "y", "_sd", F.inline(F.array(*picks))).where(
        F.col("yhat").isNotNull()
    ).select(
        *keys, "model", "cutoff", "ds", "horizon", "y", "yhat",
        (F.col("yhat") - half).alias("yhat_lower"), (F.col("yhat") + half).alias("yhat_upper"),
    )
