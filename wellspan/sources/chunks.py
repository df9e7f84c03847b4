"""Planning of incremental loads: resume dates, yearly chunks and the missing-chunk ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_dates(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Last known date per station."""
    return df.groupBy(*keys).agg(F.max(t).alias("last_date"))


def resume_dates(
    stations: DataFrame,
    last: DataFrame,
    keys: list[str],
    default_start: Column,
    lookback_days: int = 0,
) -> DataFrame:
    """Day after the last known date, or the default for stations without history.

    ``lookback_days`` re-reads that many already loaded days, to pick up late corrections.
    """
    resumed = F.date_add(F.col("last_date"), 1 - lookback_days)
    return stations.join(last, keys, "left").withColumn(
        "start_date", F.coalesce(resumed, default_start)
    )


def plan_chunks(stations: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per station and calendar year of its period, clipped to the period."""
    year = F.explode(F.sequence(F.year(start), F.year(end))).alias("year")
    return (
        stations.where(F.col(start) <= F.col(end))
        .select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), year)
        .select(
            *keys,
            "year",
            F.greatest("_s", F.make_date("year", F.lit(1), F.lit(1))).alias("chunk_start"),
            F.least("_e", F.make_date("year", F.lit(12), F.lit(31))).alias("chunk_end"),
        )
    )


def missing_chunks(plan: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Planned chunks without landed rows: the retry list."""
    return plan.join(landed, [*keys, "year"], "left_anti")
