"""Stream jobs as queries: each runs over all landed event files and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan.plans import daily_queries
from wellspan.plans.registry import ENTRIES, q6, query, r6
from wellspan.session import scratch_path
from wellspan.streaming import jobs

# a window is emitted once the newest reading is a day past its end
_CLOSED = "(SELECT MAX(ts) - INTERVAL 1 DAY FROM events)"


def _landed(sf_dir):
    # a pattern, since the stream source takes a single file only that way
    return f"{sf_dir.rstrip('/')}/event[s].parquet"


def _stream(spark, sf_dir):
    return jobs.readings_stream(spark, _landed(sf_dir))


@query("stream_daily_mean", f"""
SELECT event_type AS station, CAST(ts AS DATE) AS t, {q6('AVG(value)')} AS mean_value, COUNT(*) AS n FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2""")
def stream_daily_mean(spark, sf_dir):
    out = jobs.run_to_files(jobs.daily_mean_stream(_stream(spark, sf_dir)), "daily-mean")
    return out.withColumn("mean_value", r6("mean_value"))


@query("stream_dedupe", "SELECT event_type AS station, event_id, value FROM events")
def stream_dedupe(spark, sf_dir):
    twice = _stream(spark, sf_dir)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = jobs.run_to_files(jobs.dedupe_stream(twice, ["event_id"]), "dedupe")
    return out.select("station", "event_id", "value")


@query("stream_sliding_30d", f"""
WITH d AS (SELECT event_type AS station, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,4))) AS v, COUNT(*) AS n FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2),
e AS (SELECT CAST(UNNEST(generate_series(MIN(ts), MAX(ts) + INTERVAL 31 DAY, INTERVAL 1 DAY)) AS DATE) AS t FROM events)
SELECT d.station, e.t, CAST(SUM(d.v) AS DOUBLE) AS total, CAST(SUM(d.n) AS BIGINT) AS n FROM d JOIN e ON d.day <= e.t AND d.day > e.t - 30
WHERE e.t + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2""")
def stream_sliding_30d(spark, sf_dir):
    return jobs.run_to_files(jobs.sliding_sum_stream(_stream(spark, sf_dir)), "sliding")


@query("stream_upsert_last", """
SELECT user_id, t, event_id, value FROM (SELECT user_id, CAST(ts AS DATE) AS t, event_id, value,
  ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id % 2 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert_last(spark, sf_dir):
    """Latest reading per user and day. The events land as two deliveries, merged one after the other."""
    landed = scratch_path(spark, "landed")
    events = spark.read.schema(jobs.T.StructType(jobs.EVENT_FIELDS)).parquet(_landed(sf_dir))
    path, checkpoint = scratch_path(spark, "history"), scratch_path(spark, "history-progress")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(landed)
        rows = spark.readStream.schema(events.schema).parquet(landed).select("user_id", F.to_date("ts").alias("t"), "event_id", "value")
        jobs.upsert_stream(rows, path, checkpoint, "user_id", "t", ["event_id"])
    return jobs.read_history(spark, path, rows.schema, "user_id", "t", ["event_id"])


@query("stream_high_water_mark", "SELECT user_id, MAX(CAST(ts AS DATE)) AS last_date FROM events GROUP BY 1")
def stream_high_water_mark(spark, sf_dir):
    reader = spark.readStream.schema(jobs.T.StructType(jobs.EVENT_FIELDS)).parquet(_landed(sf_dir))
    rows = reader.select("user_id", F.to_date("ts").alias("t"), "event_id", "value")
    path = scratch_path(spark, "history")
    jobs.upsert_stream(rows, path, scratch_path(spark, "history-progress"), "user_id", "t", ["event_id"])
    return jobs.high_water_mark(spark, path, rows.schema, "user_id", "t")


def _landed_twice(spark, label, documents, half, stream):
    """Documents land in two deliveries, each followed by a run that goes on from the checkpoint of the last."""
    landed, table, progress = (scratch_path(spark, f"{label}-{p}") for p in ("in", "table", "progress"))
    rows = None
    for part in (half, ~half):
        documents.where(part).select("value").write.mode("append").text(landed)
        rows = jobs.run_to_files(stream(landed), label, checkpoint=progress, path=table)
    return rows


@query("stream_observation_pages", ENTRIES["observation_pages"].sql)
def stream_observation_pages(spark, sf_dir):
    """Observation pages read as they land; the rows are those of the batch reader."""
    documents = daily_queries.observation_documents(spark, sf_dir)
    rows = _landed_twice(spark, "pages", documents, F.col("page") % 2 == 0, lambda p: jobs.pages_stream(spark, p))
    return rows.select("code_bss", "bss_id", "date_mesure", "niveau_nappe_eau", "statut")


@query("stream_weather_documents", ENTRIES["weather_documents"].sql)
def stream_weather_documents(spark, sf_dir):
    """Weather documents read as they land; the rows are those of the batch reader."""
    documents = daily_queries.weather_document_rows(spark, sf_dir)
    return _landed_twice(spark, "weather", documents, F.col("year") < 1996, lambda p: jobs.weather_stream(spark, p))


@query("stream_event_runs", f"""
WITH d AS (SELECT event_type AS station, CAST(ts AS DATE) AS t, AVG(value) AS m FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2),
n AS (SELECT *, m > 50 AS hit, ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) AS rn, MAX(t) OVER (PARTITION BY station) AS last_day FROM d),
g AS (SELECT *, rn - ROW_NUMBER() OVER (PARTITION BY station, hit ORDER BY t) AS grp FROM n)
SELECT station, MIN(t) AS start, MAX(t) AS "end", COUNT(*) AS duration, {q6('MAX(m)')} AS peak, {q6('SUM(m - 50)')} AS severity
FROM g WHERE hit GROUP BY station, grp, last_day HAVING MAX(t) < last_day""")
def stream_event_runs(spark, sf_dir):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.run_to_files(jobs.event_runs_stream(_stream(spark, sf_dir), 50.0), "runs")
    finally:
        spark.conf.set(provider, before)
    return out.withColumns({"peak": r6("peak"), "severity": r6("severity")})
