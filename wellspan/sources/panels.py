"""Daily station panels derived from the driver tables.

Every panel is an aggregate to (station, day), with partial aggregation before the shuffle; a
station that holds a third of all raw rows still shuffles at most one row per day and task. All
sums run over whole hundredths in LONG, so results do not depend on the order of addition, and
no decimal object is made per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: Column) -> Column:
    return F.rint(c * 100).cast("long")


def _dsum(c: Column) -> Column:
    """Exact sum of amounts with two decimals."""
    return F.sum(_cents(c)) / F.lit(100.0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings: one row per order, several per station and day."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("station"),
        F.to_date("o_orderdate").alias("t"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("level"),
        F.col("o_orderstatus").alias("status"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily level per station; gappy at small scale."""
    return (
        readings(spark, sf_dir)
        .groupBy("station", "t")
        .agg((_dsum(F.col("level")) / F.count(F.lit(1))).alias("level"))
    )


def wx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather-like drivers per station."""
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = F.count(F.lit(1))
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    return (
        lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderpriority").alias("station"), F.to_date("l_shipdate").alias("t"))
        .agg(
            _dsum(q).alias("precip"),
            (F.sum(_cents(q) * _cents(d)) / F.lit(10000.0)).alias("et0"),
            (_dsum(q) / n).alias("soil_temp"),
            (_dsum(d) / n).alias("soil_moist"),
            _dsum(x).alias("radiation"),
            (_dsum(F.col("l_tax")) / n).alias("wind"),
            (F.sum("l_linenumber").cast("double") / n).alias("cloud"),
            (F.sum(F.col("l_partkey") % 1000).cast("double") / n).alias("pressure"),
            F.max(q).alias("tmax"),
        )
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather spine with the level attached where observed."""
    return wx(spark, sf_dir).join(obs(spark, sf_dir), ["station", "t"], "left")


def named(df: DataFrame) -> DataFrame:
    """Panel columns under the feed's column names."""
    return df.withColumnsRenamed({
        "station": "code_bss",
        "t": "date_index",
        "level": "niveau_nappe_eau",
        "precip": "precipitation_sum",
        "et0": "et0_fao_evapotranspiration",
        "soil_temp": "soil_temperature_0_to_100cm_mean",
        "soil_moist": "soil_moisture_0_to_100cm_mean",
        "radiation": "shortwave_radiation_sum",
        "wind": "wind_speed_10m_mean",
        "cloud": "cloud_cover_mean",
        "pressure": "pressure_msl_mean",
        "tmax": "temperature_2m_max",
    })


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement period per station."""
    return readings(spark, sf_dir).groupBy("station").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n_readings")
    )


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event readings with a zoned timestamp."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id", "value",
    )


def supplier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide network: one station per supplier, daily mean line price (stations grow with data)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("t"))
        .agg((_dsum(F.col("l_extendedprice")) / F.count(F.lit(1))).alias("level"))
    )
