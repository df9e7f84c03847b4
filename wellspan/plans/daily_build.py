"""The composed daily build: deliveries are merged into a history, the history becomes the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from wellspan.operators.joins import merge_obs
from wellspan.plans.features import feature_table
from wellspan.sources import chunks
from wellspan.streaming import jobs


def next_chunks(stations: DataFrame, history: str, schema, key: str, t: str, first: Column, end: str) -> DataFrame:
    """What to fetch next, by station and year: from the day after its last loaded one, or from ``first``, to ``end``."""
    last = jobs.high_water_mark(stations.sparkSession, history, schema, key, t)
    return chunks.plan_chunks(chunks.resume_dates(stations, last, [key], first), [key], "start_date", end)


def load(deliveries: list[DataFrame], history: str, key: str, t: str, order: list[str]) -> DataFrame:
    """Merge deliveries into the table at ``history``, one after the other, and return its rows.

    A delivery may have several readings a day, the last by ``order`` counts; later deliveries win. Each
    is added to the table, and what was loaded before stays as it is.
    """
    for rows in deliveries:
        jobs.merge_batch(rows, history, key, t, order)
    return jobs.read_history(deliveries[0].sparkSession, history, deliveries[0].schema, key, t, order)


def daily_build(
    deliveries: list[DataFrame], weather: DataFrame, history: str, key: str, t: str, order: list[str],
) -> DataFrame:
    """Feature table of the weather calendar and the readings loaded so far, the new deliveries included.

    ``weather`` and the deliveries have the feed's column names.
    """
    levels = load(deliveries, history, key, t, order).drop(*order)
    return feature_table(merge_obs(weather, levels, [key, t]), [key], t)
