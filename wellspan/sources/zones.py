"""Zone tables (raw, interim, processed), snapshots and result records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wellspan.operators.clean import nan_to_null, sortable


def read_zone(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Zone table; CSV needs a declared schema, empty fields and NaN become NULL."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV zone needs a schema")
        return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.format(fmt).load(path))


def write_zone(
    df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet"
) -> str:
    """Full overwrite of a zone table.

    With ``partition_by`` the rows are first clustered on those columns, so each task writes few
    directories; the rebalance lets AQE split a partition value that holds most rows.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by)
    out = writer.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "static")
    if fmt == "csv":
        out = out.option("header", True)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.save(path)
    return path


def snapshot_path(prefix: str, name: str, asof: dt.date) -> str:
    """``prefix/yyyy/MM/name_yyyyMMdd``."""
    return f"{prefix.rstrip('/')}/{asof:%Y}/{asof:%m}/{name}_{asof:%Y%m%d}"


def write_snapshot(df: DataFrame, prefix: str, name: str, asof: dt.date) -> str:
    path = snapshot_path(prefix, name, asof)
    df.withColumn("snapshot_date", F.lit(asof)).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)
    return path


def load_history(spark: SparkSession, *paths: str) -> tuple[DataFrame, ...]:
    """All history tables, or the reader's path error when one is missing."""
    return tuple(spark.read.parquet(p) for p in paths)


def preview(df: DataFrame, t: str = "date", n: int = 50) -> DataFrame:
    """The last ``n`` rows by date, date shown as text (a top-n, never a full sort).

    Rows of one day are taken in the order of their other columns.
    """
    return df.orderBy(F.col(t).desc(), *sortable(df, [t])).limit(n).withColumn(t, F.date_format(t, "yyyy-MM-dd"))


def forecast_record(forecast: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record per station: ``last_train`` and the dated points.

    A station contributes one point per forecast day, so the array is bounded by the horizon and
    the training span.
    """
    point = F.struct(
        F.date_format("ds", "yyyy-MM-dd").alias("ds"), "yhat", "yhat_lower", "yhat_upper"
    )
    points = forecast.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return (
        points.join(last, keys)
        .select(
            *keys,
            F.to_json(
                F.struct(F.date_format("last_train", "yyyy-MM-dd").alias("last_train"), "points")
            ).alias("record"),
        )
    )


def write_tuning(results: DataFrame, path: str) -> str:
    """Tuning table, one folder per horizon; reading the root gives the combined table."""
    return write_zone(results, path, ["horizon"])
