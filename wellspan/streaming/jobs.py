"""Stream jobs on landed readings.

Every job runs with ``availableNow`` (all files landed so far, then stop) and keeps its progress
in a checkpoint folder, so the next run goes on where the last one ended. Sinks are files in
shared storage; a batch that is written twice replaces itself.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellspan import schemas
from wellspan.operators.clean import dedupe_last
from wellspan.session import scratch_path
from wellspan.sources import feeds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_FIELDS = [
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
]


def readings_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New event files as a stream of (station, ts, event_id, value)."""
    reader = spark.readStream.schema(T.StructType(EVENT_FIELDS))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select(
        F.col("event_type").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )


def run_to_files(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Process what has landed into Parquet files and return them as a table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    checkpoint = checkpoint or scratch_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def dedupe_stream(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Repeated deliveries removed; a key is remembered for ``delay`` of event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def daily_mean_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling daily mean per station, emitted once the watermark has passed the day."""
    day = F.window("ts", "1 day")
    return (
        stream.withWatermark("ts", delay).groupBy("station", day.alias("w"))
        .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
        .select("station", F.to_date("w.start").alias("t"), "mean_value", "n")
    )


def sliding_sum_stream(stream: DataFrame, span: str = "30 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Cumulative value over a sliding window.

    Values are summed per day first, so a reading is repeated for the 30 windows it belongs to
    only as part of a daily sum.
    """
    daily = (
        stream.withWatermark("ts", delay).groupBy("station", F.window("ts", step).alias("d"))
        .agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("v"), F.count(F.lit(1)).alias("n"))
        .select("station", F.window_time("d").alias("ts"), "v", "n")
    )
    return (
        daily.groupBy("station", F.window("ts", span, step).alias("w"))
        .agg(F.sum("v").cast("double").alias("total"), F.sum("n").alias("n"))
        .select("station", F.to_date(F.col("w.end") - F.expr("interval 1 microsecond")).alias("t"), "total", "n")
    )


# --- keep-last history -------------------------------------------------------------------
#
# A history table is a Parquet table partitioned by month and batch. A merge appends the last reading of
# each day of its batch and touches nothing that is there; a reader keeps the last batch of each day. So a
# merge costs what it brings, whatever the table holds, and one that is lost or run twice changes no result:
# what it may have left is older than what the next run adds. ``compact_history`` folds the batches.


def read_if_there(spark: SparkSession, path: str, schema: T.StructType, folders: str = "") -> DataFrame:
    """The rows of a table that may not have been written yet, or of those of its ``folders`` (a pattern) that are there."""
    reader = spark.read.schema(schema)
    try:
        return reader.option("basePath", path).parquet(f"{path}/{folders}") if folders else reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _batches(spark: SparkSession, path: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame:
    whole = T.StructType([*schema, T.StructField("month", T.StringType()), T.StructField("batch", T.LongType())])
    if months is None:
        return read_if_there(spark, path, whole)
    # anything else is no month of a date, so that there is no folder of it
    months = [m for m in months if re.fullmatch(r"[+-]?[0-9]+-[0-9]{2}", m or "")]
    if not months:
        return spark.createDataFrame([], whole)
    return read_if_there(spark, path, whole, f"month={{{','.join(months)}}}").where(F.col("month").isin(months))


def read_history(spark: SparkSession, path: str, schema: T.StructType, key: str, t: str, order: list[str], months: list[str] | None = None) -> DataFrame:
    """The last reading of every station and day, of some months (yyyy-MM) only if asked; other folders are neither listed nor opened."""
    rows = _batches(spark, path, schema, months)
    return dedupe_last(rows, [key, t], ["batch", *order]).select(*schema.names)


def merge_batch(batch: DataFrame, path: str, key: str, t: str, order: list[str]) -> None:
    """Add the last reading of each station and day of a batch; from now on it counts instead of older ones."""
    spark = batch.sparkSession
    number = _batches(spark, path, batch.schema).agg(F.coalesce(F.max("batch") + 1, F.lit(0).cast("bigint"))).first()[0]
    new = dedupe_last(batch, [key, t], order).withColumns({"month": F.date_format(t, "yyyy-MM"), "batch": F.lit(number)})
    # rows of a month go to few files, those of a huge one to several
    new.hint("rebalance", "month").write.mode("append").partitionBy("month", "batch").parquet(path)


def compact_history(spark: SparkSession, path: str, to: str, schema: T.StructType, key: str, t: str, order: list[str]) -> None:
    """Write the current rows as a new table of one batch, to go on with instead of the old one."""
    rows = read_history(spark, path, schema, key, t, order)
    rows = rows.withColumns({"month": F.date_format(t, "yyyy-MM"), "batch": F.lit(0).cast("bigint")})
    rows.hint("rebalance", "month").write.partitionBy("month", "batch").parquet(to)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, t: str, order: list[str]) -> None:
    """Merge all newly landed readings into the history table at ``path``."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path, key, t, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def high_water_mark(spark: SparkSession, path: str, schema: T.StructType, key: str, t: str) -> DataFrame:
    """Last loaded date per station of a history table; replaced readings have the same day, so none is folded."""
    return _batches(spark, path, schema).groupBy(key).agg(F.max(t).alias("last_date"))


# --- landed feed documents ---------------------------------------------------------------

def pages_stream(spark: SparkSession, path: str, schema: T.StructType = schemas.OBSERVATION_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Newly landed observation pages as a stream of readings, as ``feeds.read_obs_pages`` gives them."""
    return feeds.page_rows(_documents(spark, path, schemas.page_schema(schema), max_files))


def weather_stream(spark: SparkSession, path: str, variables: dict[str, str] | None = None, max_files: int | None = None) -> DataFrame:
    """Newly landed weather documents as a stream of days, as ``feeds.read_weather_docs`` gives them."""
    return feeds.weather_rows(_documents(spark, path, schemas.weather_doc_schema(variables), max_files), variables)


def corrupt_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Newly landed lines that are no document of ``schema``, with their file, to be looked at and landed again."""
    # lines as text, since the JSON reader doesn't hand out its corrupt records alone
    lines = _limited(spark, max_files).text(path)
    parsed = F.from_json("value", _declared(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.where(parsed[CORRUPT].isNotNull()).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("line"))


CORRUPT = "_corrupt_record"


def _declared(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])


def _limited(spark: SparkSession, max_files: int | None):
    return spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream


def _documents(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    """One JSON document a line; a line that is none is kept whole in ``_corrupt_record``, all else NULL."""
    reader = _limited(spark, max_files).schema(_declared(schema))
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


# --- threshold runs with state -----------------------------------------------------------

RUN_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()), T.StructField("start", T.DateType()),
    T.StructField("end", T.DateType()), T.StructField("duration", T.LongType()),
    T.StructField("peak", T.DoubleType()), T.StructField("severity", T.DoubleType()),
])
OPEN_RUN = T.StructType([
    T.StructField("start", T.DateType()), T.StructField("last", T.DateType()),
    T.StructField("duration", T.LongType()), T.StructField("peak", T.DoubleType()),
    T.StructField("severity", T.DoubleType()),
])


class RunTracker(StatefulProcessor):
    """Open threshold run of a station; a finished run is emitted by the day that ends it.

    State is one small record per station. Days arrive finished (the daily mean upstream emits a
    day once), so ordering them within a batch is enough.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_run = handle.getValueState("open_run", OPEN_RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("t")
        run = self.open_run.get() if self.open_run.exists() else None
        done = []
        for day, value in zip(days["t"], days["mean_value"]):
            excess = float(value) - self.threshold
            if excess > 0:
                if run is None:
                    run = (day, day, 1, float(value), excess)
                else:
                    run = (run[0], day, run[2] + 1, max(run[3], float(value)), run[4] + excess)
            elif run is not None:
                done.append((key[0], *run))
                run = None
        if run is not None:
            self.open_run.update(run)
        else:
            self.open_run.clear()
        if done:
            yield pd.DataFrame(done, columns=[f.name for f in RUN_SCHEMA])

    def close(self) -> None:
        pass


def event_runs_stream(stream: DataFrame, threshold: float, delay: str = "1 day") -> DataFrame:
    """Runs of days whose mean exceeds the threshold, as they end."""
    days = daily_mean_days(stream, delay)
    return days.groupBy("station").transformWithStateInPandas(
        statefulProcessor=RunTracker(threshold), outputStructType=RUN_SCHEMA, outputMode="append", timeMode="None",
    )


def daily_mean_days(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Finished daily means with their event time kept, to feed a further stateful step."""
    return (
        stream.withWatermark("ts", delay).groupBy("station", F.window("ts", "1 day").alias("w"))
        .agg(F.avg("value").alias("mean_value"))
        .select("station", F.to_date("w.start").alias("t"), "mean_value", F.window_time("w").alias("ts"))
    )
