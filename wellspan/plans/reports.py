"""Drought report, analysis extract and forecast job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan import schemas
from wellspan.functions.labels import severity_label
from wellspan.operators.events import characterize_events, event_extremes
from wellspan.operators.indices import forecast_index, index_panel
from wellspan.operators.quality import kpis
from wellspan.operators.tuning import refit_best, top_configs, tune
from wellspan.session import reuse


def drought_report(
    df: DataFrame, keys: list[str], t: str, level: str,
    scales: tuple[int, ...] = schemas.SCALES, threshold: float = -1.5,
) -> DataFrame:
    """Longest and most intense drought per station and scale of the level index."""
    spec = [schemas.IndexSpec("SPLI", level, "mean")]
    panel = index_panel(df, keys, t, spec, scales)
    by = [*keys, "scale"]
    events = characterize_events(panel, by, "month", "z", threshold)
    return event_extremes(events, by).withColumn("severity_class", severity_label(F.col("peak")))


def analysis_extract(df: DataFrame, keys: list[str], t: str, level: str, threshold: float = -1.5) -> DataFrame:
    """Key figures per station: rows, span, index months, drought events."""
    panel = index_panel(df, keys, t, [schemas.IndexSpec("SPLI", level, "mean")], (1,))
    events = characterize_events(panel, keys, "month", "z", threshold)
    return kpis(df, keys, t, panel, events)


def level_feature_pairs(df: DataFrame, keys: list[str], t: str, level: str, features: list[str]) -> DataFrame:
    """Complete (level, feature) pairs in long form, for scatter views."""
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    return df.select(*keys, t, level, F.inline(F.array(*rows))).dropna(subset=[level, "value"])


def recent_window(df: DataFrame, keys: list[str], t: str, days: int = schemas.HISTORY_WINDOW_DAYS) -> DataFrame:
    """The last ``days`` days of each station."""
    last = F.max(t).over(Window.partitionBy(*keys))
    return df.withColumn("_last", last).where(F.col(t) >= F.date_sub("_last", days)).drop("_last")


def forecast_job(
    daily: DataFrame, keys: list[str], t: str, y: str, columns: list[str], h: int
) -> dict[str, DataFrame]:
    """Sweep, refit and index of the forecast for one horizon."""
    results = reuse(tune(daily, keys, t, y, columns, (h,)))
    forecast = reuse(refit_best(daily, keys, t, y, columns, h, results))
    last = forecast.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("ds").alias("last_train"))
    observed = daily.select(*keys, F.col(t).alias("ds"), F.col(y).alias("y"))
    index = forecast_index(observed, forecast, last, keys).withColumn("label", severity_label(F.col("spli")))
    return {"results": results, "best": top_configs(results, keys, 5), "forecast": forecast, "index": index}
