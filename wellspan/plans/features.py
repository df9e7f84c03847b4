"""The processed daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan import schemas
from wellspan.operators.clean import conform_daily, with_water_balance
from wellspan.operators.indices import attach_indices, index_panel, pivot_panel
from wellspan.operators.rolling import water_balance_features
from wellspan.session import reuse

RAIN, ET0 = "precipitation_sum", "et0_fao_evapotranspiration"
SOIL_TEMPERATURE = "soil_temperature_0_to_100cm_mean"


def conformed_features(df: DataFrame, keys: list[str], t: str, order: list[str] | None = None) -> DataFrame:
    """Conformed daily rows with cumulative rain, effective rain and mean temperature.

    A trailing day without a level takes the last known one, so ``is_observed`` tells which rows
    were really measured.
    """
    flagged = df.withColumn("is_observed", F.col(schemas.LEVEL).isNotNull())
    daily = conform_daily(flagged, keys, t, order=order)
    return water_balance_features(daily, keys, t, RAIN, ET0, SOIL_TEMPERATURE)


def monthly_indices(daily: DataFrame, keys: list[str], t: str, scales: tuple[int, ...] = (1,)) -> DataFrame:
    return index_panel(with_water_balance(daily, RAIN, ET0), keys, t, schemas.INDEX_SPECS, scales)


def feature_table(df: DataFrame, keys: list[str], t: str, order: list[str] | None = None) -> DataFrame:
    """Daily table with rolling features and all standardised indices.

    ``df`` may have several readings a day; the first one by ``order`` counts.
    """
    daily = reuse(conformed_features(df, keys, t, order))
    names = [s.name for s in schemas.INDEX_SPECS]
    wide = pivot_panel(monthly_indices(daily, keys, t), keys, names, scale=1)
    return attach_indices(daily, wide, keys, t, names)
