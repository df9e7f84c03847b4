"""Joins of daily and monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.functions.dates import doy_ring, month_start


def merge_obs(weather: DataFrame, obs: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Weather as the spine, observations attached on (day, station); ``how='inner'`` keeps matches."""
    return weather.join(obs, keys, how)


def audit_join(df: DataFrame, column: str = "sunrise") -> DataFrame:
    """Row count and rows without a match."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_unmatched"))


def broadcast_month(daily: DataFrame, panel: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Each day takes the panel row of its own month; a missing month gives NULL.

    No broadcast hint: the panel grows with the number of stations. Spark broadcasts it by
    measured size when it is small and otherwise shuffles both sides on (station, month).
    """
    return (
        daily.withColumn("month", month_start(t)).join(panel, [*keys, "month"], "left").drop("month")
    )


def asof_month(daily: DataFrame, panel: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Each day takes the latest panel row whose month is not after the day.

    Union of both sides plus a running last value: one shuffle by station and no range join.
    """
    wide = panel.select(
        *keys, F.col("month").alias(t), F.struct(*columns).alias("_v"), F.lit(0).alias("_side")
    )
    rest = [c for c in daily.columns if c not in (*keys, t)]
    days = daily.select(*keys, t, F.struct(*rest).alias("_d"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = days.unionByName(wide, allowMissingColumns=True)
    return (
        both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_side") == 1)
        .select(*keys, t, "_d.*", *[F.col("_v")[c].alias(c) for c in columns])
    )


def align(a: DataFrame, b: DataFrame, on: list[str], a_col: str, b_col: str) -> DataFrame:
    """Rows present and non-NULL on both sides."""
    left = a.where(F.col(a_col).isNotNull()).select(*on, a_col)
    right = b.where(F.col(b_col).isNotNull()).select(*on, b_col)
    return left.join(right, on)


def map_seasonal(daily: DataFrame, seasonal: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Each day takes the seasonal value of its calendar month."""
    return daily.withColumn("moy", F.month(t)).join(seasonal, [*keys, "moy"], "left").drop("moy")



def compound_frame(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Outer concat of two month flags followed by dropping incomplete rows."""
    return a.join(b, on, "full_outer").dropna()


def overlap_count(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Number of shared keys of two splits (must be zero)."""
    return a.select(*on).intersect(b.select(*on)).agg(F.count(F.lit(1)).alias("n_overlap"))
