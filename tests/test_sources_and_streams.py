import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wellspan import schemas
from wellspan.session import materialize, shared_root
from wellspan.sources import chunks, feeds, zones
from wellspan.streaming import jobs


def test_pages_and_documents(spark, tmp_path):
    page = {"data": [{"code_bss": "s1", "date_mesure": "2024-01-02", "niveau_nappe_eau": 1.5}], "next": None}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text(json.dumps({"data": [], "next": "more"}))
    rows = feeds.read_obs_pages(spark, str(tmp_path), with_source=True).collect()
    assert len(rows) == 1 and rows[0].date_mesure == dt.date(2024, 1, 2) and rows[0].source_file.endswith("p1.json")

    folder = tmp_path / "w"
    folder.mkdir()
    doc = {"code_bss": "s1", "latitude": 1.0, "longitude": 2.0, "daily": {"time": ["2024-01-01", "2024-01-02"], "rain_sum": [None, 3.5]}}
    (folder / "d.json").write_text(json.dumps(doc))
    days = feeds.read_weather_docs(spark, str(folder), {"rain_sum": "double"}).orderBy("date").collect()
    assert [(str(r.date), r.rain_sum, r.code_bss) for r in days] == [("2024-01-01", None, "s1"), ("2024-01-02", 3.5, "s1")]


def test_station_coordinates(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"code_bss": "s1", "x": 2.5, "y": 48.0}]}))
    row = feeds.read_stations(spark, str(tmp_path)).first()
    assert row.longitude == 2.5 and row.latitude == 48.0


def test_zone_overwrite_and_csv_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1.0), ("b", 2021, None)], "k string, year int, x double")
    path = zones.write_zone(df, str(tmp_path / "z"), ["year"])
    zones.write_zone(df.where("year = 2021"), path, ["year"])
    assert zones.read_zone(spark, path).count() == 1  # a full overwrite, not only the touched folder
    csv = zones.write_zone(df, str(tmp_path / "c"), fmt="csv")
    back = zones.read_zone(spark, csv, df.schema, "csv").orderBy("k").collect()
    assert [r.x for r in back] == [1.0, None]
    with pytest.raises(ValueError):
        zones.read_zone(spark, csv, fmt="csv")


def test_snapshot_path_and_missing_history(spark, tmp_path):
    assert zones.snapshot_path("p/", "n", dt.date(2024, 3, 9)) == "p/2024/03/n_20240309"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        zones.load_history(spark, str(tmp_path / "nothing"))


def test_resume_with_lookback(spark):
    stations = spark.createDataFrame([("a",), ("b",)], "k string")
    last = spark.createDataFrame([("a", dt.date(2024, 1, 10))], "k string, last_date date")
    default = F.lit(dt.date(2017, 1, 1))
    out = {r.k: r.start_date for r in chunks.resume_dates(stations, last, ["k"], default).collect()}
    assert out == {"a": dt.date(2024, 1, 11), "b": dt.date(2017, 1, 1)}
    out = {r.k: r.start_date for r in chunks.resume_dates(stations, last, ["k"], default, 5).collect()}
    assert out["a"] == dt.date(2024, 1, 6)


def test_chunks_clip_to_the_period(spark):
    df = spark.createDataFrame([("a", dt.date(2019, 6, 1), dt.date(2021, 2, 1)), ("b", dt.date(2022, 1, 1), dt.date(2021, 1, 1))], "k string, s date, e date")
    plan = chunks.plan_chunks(df, ["k"], "s", "e").orderBy("year")
    assert [(r.year, str(r.chunk_start), str(r.chunk_end)) for r in plan.collect()] == [
        (2019, "2019-06-01", "2019-12-31"), (2020, "2020-01-01", "2020-12-31"), (2021, "2021-01-01", "2021-02-01"),
    ]


def test_materialize_uses_the_shared_folder(spark):
    out = materialize(spark.range(5), "t")
    assert out.count() == 5 and shared_root(spark) in out.inputFiles()[0]


def write_events(spark, path, rows):
    schema = jobs.T.StructType(jobs.EVENT_FIELDS)
    data = [(i, ts, 1, k, v, None) for i, ts, k, v in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def at(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_upsert_stream_over_two_deliveries(spark, tmp_path):
    landed, table, progress = (str(tmp_path / p) for p in ("in", "table", "progress"))

    def deliver():
        s = spark.readStream.schema(jobs.T.StructType(jobs.EVENT_FIELDS)).parquet(landed)
        s = s.select(F.col("event_type").alias("k"), F.to_date("ts").alias("t"), "event_id", "value")
        jobs.upsert_stream(s, table, progress, "k", "t", ["event_id"])

    write_events(spark, landed, [(1, at(1), "a", 1.0), (2, at(1, 5), "a", 2.0), (3, at(2), "b", 3.0)])
    deliver()
    write_events(spark, landed, [(4, at(1), "a", 9.0), (5, at(3), "a", 4.0)])
    deliver()
    deliver()  # nothing new
    schema = "k string, t date, event_id bigint, value double"
    schema = spark.createDataFrame([], schema).schema
    rows = {(r.k, r.t.day): r.value for r in jobs.read_history(spark, table, schema, "k", "t", ["event_id"]).collect()}
    assert rows == {("a", 1): 9.0, ("b", 2): 3.0, ("a", 3): 4.0}
    marks = {r.k: r.last_date.day for r in jobs.high_water_mark(spark, table, schema, "k", "t").collect()}
    assert marks == {"a": 3, "b": 2}


def test_event_runs_across_batches(spark, tmp_path):
    """An open run survives from one micro-batch, and one restart, to the next."""
    landed = str(tmp_path / "in")
    values = [1.0, 12.0, 13.0, 11.0, 2.0, 15.0, 1.0, 1.0, 1.0]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
        for lo, hi in ((0, 4), (4, 9)):
            write_events(spark, landed, [(d, at(d + 1, 6), "a", values[d]) for d in range(lo, hi)])
            s = jobs.event_runs_stream(jobs.readings_stream(spark, landed, max_files=1), 10.0)
            got = jobs.run_to_files(s, "runs", path=out, checkpoint=progress)
        rows = got.orderBy("start").collect()
    finally:
        spark.conf.set(key, before)
    assert [(r.start.day, r.end.day, r.duration, r.peak, r.severity) for r in rows] == [
        (2, 4, 3, 13.0, 6.0), (6, 6, 1, 15.0, 5.0),
    ]
