"""Trend, season and remainder of regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.functions.stats import ratio
from wellspan.operators.rolling import frame_sums, with_centered_mean


def climatology(df: DataFrame, keys: list[str], t: str, column: str, out: str = "seasonal") -> DataFrame:
    """Mean by calendar month, centred so that the months average to zero."""
    by_month = df.groupBy(*keys, F.month(t).alias("moy")).agg(F.avg(column).alias("_m"))
    w = Window.partitionBy(*keys)
    return by_month.select(*keys, "moy", (F.col("_m") - F.avg("_m").over(w)).alias(out))


def season_profile(df: DataFrame, keys: list[str], t: str, column: str, by: str = "month") -> DataFrame:
    """Mean by calendar year and month, or by calendar year and ISO week."""
    period = F.month(t) if by == "month" else F.weekofyear(t)
    return df.groupBy(*keys, F.year(t).alias("year"), period.alias("period")).agg(F.avg(column).alias("mean"))


def decompose_classical(df: DataFrame, keys: list[str], t: str, column: str, window: int = 365) -> DataFrame:
    """Centred rolling mean as trend, zero-mean monthly climatology of the rest as season.

    The climatology stays on the rows: mean and count per calendar month by window, and the mean
    of the monthly means as the sum of ``mean / count`` over rows. No join back.
    """
    w = Window.partitionBy(*keys)
    by_month = Window.partitionBy(*keys, F.month(t))
    rows = with_centered_mean(df.select(*keys, t, F.col(column).alias("y")), keys, t, "y", window, "trend")
    rows = rows.withColumn("_d", F.col("y") - F.col("trend"))
    rows = rows.withColumns({"_m": F.avg("_d").over(by_month), "_n": F.count("_d").over(by_month)})
    share = F.when(F.col("_d").isNotNull(), F.lit(1.0) / F.when(F.col("_n") > 0, F.col("_n")))
    center = ratio(F.sum(F.col("_m") * share).over(w), F.sum(share).over(w))
    return rows.withColumn("seasonal", F.col("_m") - center).select(
        *keys, t, "y", "trend", "seasonal",
        (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"),
    )


def decompose_robust(
    df: DataFrame, keys: list[str], t: str, column: str, period: int, passes: int = 2
) -> DataFrame:
    """Robust seasonal-trend split of a dense series in a fixed number of passes.

    Each pass: the trend is the weighted centred mean of the deseasonalised series (the frame
    shrinks at the edges), the season is the median of the detrended values at each position of
    the cycle, centred to zero, and the weights of the next pass are bisquare in the remainder
    scaled by six median absolute remainders. Every step is a window or a median over the years of
    one cycle position, all partitioned by station.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    half = period // 2
    rows = df.where(F.col(column).isNotNull()).select(*keys, t, F.col(column).alias("y")).withColumns({
        "pos": F.pmod(F.row_number().over(w) - 1, F.lit(period)),
        "seasonal": F.lit(0.0),
        "weight": F.lit(1.0),
    })
    at_pos = Window.partitionBy(*keys, "pos")
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_base", F.avg("y").over(whole))
    for _ in range(passes):
        flat = F.col("y") - F.col("_base") - F.col("seasonal")
        sums = {
            "_fw": flat * F.col("weight"), "_w": F.col("weight"), "_f": flat, "_n": F.lit(1.0),
        }
        rows = frame_sums(rows.drop(*sums), keys, t, sums, half, half)
        # rows of weight zero only: a running sum leaves rounding dust there, so test against it
        weighted = F.when(F.col("_w") > 1e-6, F.col("_fw") / F.col("_w"))
        rows = rows.withColumn(
            "trend", F.col("_base") + F.coalesce(weighted, F.col("_f") / F.col("_n"))
        )
        rows = rows.withColumn(
            "_s", F.median(F.when(F.col("weight") > 0, F.col("y") - F.col("trend"))).over(at_pos)
        )
        rows = rows.withColumn("_s", F.coalesce("_s", F.lit(0.0)))
        rows = rows.withColumn("seasonal", F.col("_s") - F.avg("_s").over(whole))
        rows = rows.withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        rows = rows.withColumn("_h", F.median(F.abs("resid")).over(whole) * 6)
        u = F.coalesce(ratio(F.col("resid"), F.col("_h")), F.lit(0.0))
        rows = rows.withColumn("weight", F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(F.lit(0.0)))
    return rows.select(*keys, t, "y", "trend", "seasonal", "resid", "weight", "pos")
