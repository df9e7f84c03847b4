"""Landed feed documents to rows.

Documents are read as files with a declared schema (no inference pass), one JSON document per
line by default, so a folder of any size splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wellspan import schemas
from wellspan.functions.dates import as_date
from wellspan.operators.clean import nan_to_null


def read_obs_pages(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = schemas.OBSERVATION_SCHEMA,
    multi_line: bool = False,
    with_source: bool = False,
) -> DataFrame:
    """Rows of every landed observation page below ``path``; several stations are one read."""
    pages = spark.read.schema(schemas.page_schema(schema)).option("multiLine", multi_line).json(path)
    if with_source:
        pages = pages.withColumn("source_file", F.col("_metadata.file_path"))
        return nan_to_null(pages.select("source_file", F.inline("data")))
    return page_rows(pages)


def page_rows(pages: DataFrame) -> DataFrame:
    return nan_to_null(pages.select(F.inline("data")))


def read_weather_docs(
    spark: SparkSession,
    path: str | list[str],
    variables: dict[str, str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Column-oriented weather documents to one row per station and day."""
    kinds = variables or schemas.WEATHER_VARIABLES
    return weather_rows(spark.read.schema(schemas.weather_doc_schema(kinds)).option("multiLine", multi_line).json(path), kinds)


def weather_rows(docs: DataFrame, variables: dict[str, str] | None = None) -> DataFrame:
    kinds = variables or schemas.WEATHER_VARIABLES
    columns = [F.col("daily.time").alias("time")] + [F.col(f"daily.{v}").alias(v) for v in kinds]
    return nan_to_null(
        docs.select("code_bss", "latitude", "longitude", F.arrays_zip(*columns).alias("days"))
        .select("code_bss", "latitude", "longitude", F.inline("days"))
        .select(
            as_date("time").alias("date"), "latitude", "longitude", "code_bss", *kinds
        )
    )


def read_stations(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Station master from feed pages, coordinates renamed."""
    return rename_coordinates(read_obs_pages(spark, path, schemas.STATION_SCHEMA, multi_line))


def rename_coordinates(stations: DataFrame) -> DataFrame:
    return stations.withColumnsRenamed({"x": "longitude", "y": "latitude"})


def union_frames(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns missing on one side become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def only_stations(df: DataFrame, codes: list[str], key: str = schemas.STATION_KEY) -> DataFrame:
    return df.where(F.col(key).isin(codes))
