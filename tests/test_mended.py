"""Cases that went wrong once."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from wellspan.operators import clean, folds, lagcorr, quality
from wellspan.schemas import struct_of
from wellspan.sources import zones
from wellspan.streaming import jobs

K = ["k"]


def day(n):
    return dt.date(2020, 1, n)


def test_repeated_days_become_one_row(spark):
    rows = [("a", day(1), 1.0), ("a", day(2), 2.0), ("a", day(2), None), ("a", day(2), 2.0), ("a", day(3), 3.0)]
    df = spark.createDataFrame(rows, "k string, t date, x double")
    assert [(r.t, r.x) for r in clean.conform_daily(df, K, "t").orderBy("t").collect()] == [(day(1), 1.0), (day(2), 2.0), (day(3), 3.0)]
    gap = spark.createDataFrame([r for r in rows if r[2] != 2.0] + [("a", day(2), None)], "k string, t date, x double")
    assert [r.x for r in clean.conform_daily(gap, K, "t").orderBy("t").collect()] == [1.0, 2.0, 3.0]


def test_interpolation_of_repeated_days_does_not_divide_by_zero(spark):
    rows = [("a", day(1), 1.0), ("a", day(2), 2.0), ("a", day(2), None), ("a", day(2), 5.0)]
    df = spark.createDataFrame(rows, "k string, t date, x double")
    assert clean.interpolate_linear(df, K, "t", ["x"]).count() == 4


def test_order_inside_a_delivery(spark):
    old = spark.createDataFrame([("a", day(1), 9, 1.0)], "k string, t date, seq int, x double")
    new = spark.createDataFrame([("a", day(1), s, float(s)) for s in (3, 7, 5)], old.schema).repartition(3)
    assert [r.x for r in clean.upsert_last(old, new, ["k", "t"], ["seq"]).collect()] == [7.0]
    assert [r.x for r in clean.upsert_last(old, new, ["k", "t"]).collect()] == [7.0]


def test_drivers_pair_with_their_own_scale(spark):
    rows = [("a", n, s, day(1), float(s * 100 + v)) for s in (1, 12) for n, v in (("SPLI", 1), ("SPI", 2))]
    panel = spark.createDataFrame(rows, "k string, index_name string, scale int, month date, z double")
    got = {(r.scale, r.value, r.response) for r in lagcorr.index_driver_pairs(panel, K, "SPLI").collect()}
    assert got == {(1, 102.0, 101.0), (12, 1202.0, 1201.0)}


def test_text_nan_in_csv_is_missing(spark, tmp_path):
    path = tmp_path / "zone"
    path.mkdir()
    (path / "part.csv").write_text("k,x\na,NaN\na,2.0\na,\n")
    rows = zones.read_zone(spark, str(path), struct_of({"k": "string", "x": "double"}), "csv")
    assert rows.agg(F.sum("x"), F.count("x")).first() == (2.0, 1)


def test_preview_breaks_ties(spark):
    rows = spark.createDataFrame([(day(1), i) for i in range(50)], "date date, v int").repartition(7)
    assert [r.v for r in zones.preview(rows, "date", 3).collect()] == [0, 1, 2]


def test_quantiles_of_a_heavy_tail(spark):
    x = np.exp(np.random.default_rng(1).uniform(0, 60, 20_000))
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    probs = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r.q: r.value for r in quality.exact_quantiles(df, "x", probs, K, bins=16, small=200).collect()}
    assert all(np.isclose(got[q], np.quantile(x, q), rtol=1e-12) for q in probs)


def test_short_stations_are_named(spark):
    rows = [("long", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(100)] + [("short", day(1))]
    df = spark.createDataFrame(rows, "k string, ds date")
    assert {r.k for r in folds.rolling_cutoffs(df, K, "ds", 5, 10).collect()} == {"long"}
    out = folds.without_cutoffs(df, K, "ds", 5).collect()
    assert [(r.k, r.reason) for r in out] == [("short", "span of 0 days is shorter than the initial 0 and the horizon 5")]


def test_merge_only_adds(spark, tmp_path):
    path = str(tmp_path / "history")
    schema = "k string, t date, seq int, x double"
    first = spark.createDataFrame([(k, dt.date(2020, m, 1), s, float(s)) for k in "abcdefgh" for m in (1, 2, 3) for s in (0, 1)], schema)
    read = lambda *months: jobs.read_history(spark, path, first.schema, "k", "t", ["seq"], *months)
    assert read().count() == 0
    jobs.merge_batch(first, path, "k", "t", ["seq"])
    second = spark.createDataFrame([("a", dt.date(2020, 2, 1), 0, 5.0), ("new", dt.date(2020, 5, 1), 0, 7.0)], schema)
    before = set(read().inputFiles())
    jobs.merge_batch(second, path, "k", "t", ["seq"])
    jobs.merge_batch(second, path, "k", "t", ["seq"])  # a repeated batch changes nothing
    jobs.merge_batch(second.limit(0), path, "k", "t", ["seq"])
    history = read()
    assert history.columns == first.columns and history.count() == 25
    assert {(r.k, r.x) for r in history.where("x >= 5").collect()} == {("a", 5.0), ("new", 7.0)}
    assert before < set(history.inputFiles())  # nothing is written anew
    assert read(["2020-02"]).count() == 8 and all("month=2020-02" in f for f in read(["2020-02"]).inputFiles())
    folded = str(tmp_path / "folded")
    jobs.compact_history(spark, path, folded, first.schema, "k", "t", ["seq"])
    again = jobs.read_history(spark, folded, first.schema, "k", "t", ["seq"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, history.collect())) and all("batch=0" in f for f in again.inputFiles())
    assert {r.k: r.last_date for r in jobs.high_water_mark(spark, path, first.schema, "k", "t").collect()}["new"] == dt.date(2020, 5, 1)


def test_history_of_months_reads_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "history")
    batch = spark.createDataFrame([("a", dt.date(2020, m, 1), 0, float(m)) for m in (1, 2, 3)] + [("a", None, 0, 9.0)], "k string, t date, seq int, x double")
    read = lambda months: jobs.read_history(spark, path, batch.schema, "k", "t", ["seq"], months)
    assert read(["2020-01"]).count() == 0  # no table yet
    jobs.merge_batch(batch, path, "k", "t", ["seq"])
    for months, want in [(["2020-02"], {2.0}), (["2020-03", "1999-01", "2020-01"], {1.0, 3.0}), (["1999-01"], set()), ([], set()),
                         (["2020-0*", "{", None], set())]:
        found = read(months)
        assert {r.x for r in found.collect()} == want and found.columns == batch.columns
        assert {f.split("month=")[1].split("/")[0] for f in found.inputFiles()} == {f"2020-0{int(x)}" for x in want}
    assert {r.x for r in read(None).collect()} == {1.0, 2.0, 3.0, 9.0}
