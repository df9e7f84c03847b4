"""Retraining, several-target regression, walk-forward trees, landed documents, contracts."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from wellspan import schemas
from wellspan.operators import clean, metrics, models, quality
from wellspan.operators.rolling import extend_and_lag
from wellspan.plans import retrain
from wellspan.sources import feeds
from wellspan.streaming import jobs

K = ["k"]
D0 = dt.date(2015, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def daily(spark, n, keys="ab", seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        x = rng.normal(size=n)
        rows += [(k, day(i), float(a), float(5 + np.sin(i / 58) + 0.3 * a)) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t date, x double, level double")


def tuned(spark, keys="ab", **params):
    values = {"changepoint_prior_scale": "0.1", "seasonality_prior_scale": "1.0", **params}
    return spark.createDataFrame([(k, 14, values) for k in keys], "k string, h int, params map<string,string>")


def test_retraining_goes_on_from_production(spark, tmp_path):
    store = str(tmp_path / "models")
    on, keys = ["k", "h"], "k string, h int"
    assert retrain.production_runs(spark, store, keys, on).count() == 0
    first = {r.k: r for r in retrain.retrain(daily(spark, 500, "a"), K, "t", "level", ["x"], store, tuned(spark), (14,)).collect()}
    assert (first["a"].new_version, first["a"].previous_version, first["a"].params_from) == (1, None, "tuning")
    # other tuning results no longer count for a, and b is new
    second = {r.k: r for r in retrain.retrain(daily(spark, 520), K, "t", "level", ["x"], store, tuned(spark, changepoint_prior_scale="0.5"), (14,)).collect()}
    assert (second["a"].new_version, second["a"].previous_version, second["a"].params_from, second["a"].changepoint_prior_scale) == (2, 1, "production", 0.1)
    assert (second["b"].new_version, second["b"].params_from, second["b"].changepoint_prior_scale, second["b"].changepoint_range) == (1, "tuning", 0.5, 0.8)
    live = {r.k: r for r in retrain.production_runs(spark, store, keys, on).collect()}
    assert {k: r.version for k, r in live.items()} == {"a": 2, "b": 1} and live["a"].run_id == second["a"].run_id != first["a"].run_id
    # a run that was registered but not promoted: production stays, numbers go on
    lost = retrain.run_table(spark, store, keys).where("k = 'a' AND version = 2").withColumns({"version": F.lit(3), "run_id": F.lit("lost")})
    lost.write.mode("append").parquet(f"{store}/runs")
    assert retrain.production_runs(spark, store, keys, on).where("k = 'a'").first().version == 2
    third = retrain.retrain(daily(spark, 530, "a"), K, "t", "level", ["x"], store, tuned(spark), (14,)).first()
    assert (third.new_version, third.previous_version) == (4, 2)
    # the stored model forecasts without being fitted again
    frame = extend_and_lag(daily(spark, 530, "a"), K, "t", ["x"], 14).select("k", F.col("t").alias("ds"), F.col("level").alias("y"), F.col("x_lag14").alias("x"))
    model = retrain.production_runs(spark, store, keys, on).where("k = 'a'").select(
        "k", "first_day", "unit_days", "coef", "sigma", F.lit(0).alias("config_id"), F.col("trained_to").alias("cutoff"), "n_train", F.lit(None).cast("string").alias("error"))
    ahead = models.predictions(frame, model, K, ["x"]).where("y IS NULL").collect()
    assert len(ahead) == 14 and all(abs(r.yhat - 5) < 3 and r.cutoff == day(529) for r in ahead)


def test_a_failed_fit_keeps_its_version(spark, tmp_path):
    store = str(tmp_path / "models")
    retrain.retrain(daily(spark, 400, "a"), K, "t", "level", ["x"], store, tuned(spark), (14,)).collect()
    bad = daily(spark, 410, "a").withColumn("level", F.lit(float("inf")))
    out = retrain.retrain(bad, K, "t", "level", ["x"], store, tuned(spark), (14,)).collect()
    assert len(out) == 1 and out[0].error and out[0].new_version is None and out[0].run_id is None
    assert retrain.production_runs(spark, store, "k string, h int", ["k", "h"]).first().version == 1


def test_several_targets_equal_separate_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = np.c_[x @ [1, 2, 3] + 1, x @ [0, -1, 5] - 2] + 0.1 * rng.normal(size=(200, 2))
    rows = [("a", *map(float, r), None if i > 150 else float(v[0]), None if i < 30 else float(v[1])) for i, (r, v) in enumerate(zip(x, y))]
    rows += [("empty", 1.0, 2.0, 3.0, None, None), ("a", None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, p double, q double").repartition(5)
    got = {r.target: r for r in models.fit_linear(df, K, ["a", "b", "c"], ["p", "q"]).collect()}
    for target, rows_ in (("p", slice(0, 151)), ("q", slice(30, 200))):
        want = np.linalg.lstsq(np.c_[np.ones(200), x][rows_], y[rows_, "pq".index(target)], rcond=None)[0]
        assert np.allclose(got[target].coef, want, atol=1e-9) and got[target].n_train == len(x[rows_]) and got[target].rank == 4


def test_collinear_columns_get_no_coefficient(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 2))
    y = x @ [2.0, -1.0] + 4
    rows = [("a", float(a), float(b), float(a + b), 7.0, float(v)) for (a, b), v in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, a double, b double, both double, flat double, y double")
    columns = ["a", "b", "both", "flat"]
    fit = models.fit_linear(df, K, columns, "y")
    one = fit.first()
    assert one.rank == 3 and one.coef[4] == 0 and sum(c == 0 for c in one.coef) == 2 and one.rss < 1e-9
    assert all(r.yhat == pytest.approx(r.y) for r in models.predict_linear(df, fit, K, columns).collect())


def test_walk_forward_trees(spark):
    rows = [(k, day(i), float(i % 7), off + 10.0 * (i % 7 > 3)) for k, off, n in (("a", 0.0, 300), ("b", 100.0, 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t date, x double, y double")
    out = models.gbt_walk_forward(df, K, "t", ["x"], "y", n_estimators=3, learning_rate=1.0, colsample=1.0).toPandas()
    test = out[out.split == "test"]
    assert not test.duplicated(["k", "ds"]).any() and sorted(test.groupby("k").size()) == [40, 60]
    for (k, month), part in out.groupby(["k", "fold_month"]):
        a, b = part[part.split == "train"], part[part.split == "test"]
        if len(b):
            assert a.ds.max() < b.ds.min() and len(a) == (b.ds.min() - D0).days
        else:
            assert a.ds.max() < month
    per_fold = metrics.split_metrics(spark.createDataFrame(out), ["k", "fold_month"]).where("n_test > 0")
    table = metrics.with_fold_mean(per_fold, K, "fold_month").toPandas()
    folds = table[table.fold_month.notna()]
    assert (folds.r2_test > 0.9).all() and (folds.r2_train > 0.9).all()
    mean = table[table.fold_month.isna()].set_index("k")
    assert mean.rmse["a"] == pytest.approx(folds[folds.k == "a"].rmse.mean()) and mean.n_test["a"] == 60
    one = models.gbt_walk_forward(df, K, "t", ["x"], "y", start=dt.date(2015, 5, 1), end=dt.date(2015, 5, 31), n_estimators=2).toPandas()
    assert set(one.fold_month) == {dt.date(2015, 5, 1)} and (one.split == "test").sum() == 62


def test_landed_pages_with_a_broken_line(spark, tmp_path):
    landed, out, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    schema = T.StructType([T.StructField("code_bss", T.StringType()), T.StructField("niveau_nappe_eau", T.DoubleType())])
    page = lambda *rows: json.dumps({"data": [{"code_bss": k, "niveau_nappe_eau": v} for k, v in rows], "next": None})
    deliveries = [[page(("a", 1.0), ("b", 2.0)), '{"data": [{"code_'], [page(("a", 3.0)), page()], []]
    for lines in deliveries:
        if lines:
            spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(landed)
        got = jobs.run_to_files(jobs.pages_stream(spark, landed, schema), "pages", checkpoint=progress, path=out)
    assert sorted((r.code_bss, r.niveau_nappe_eau) for r in got.collect()) == [("a", 1.0), ("a", 3.0), ("b", 2.0)]
    batch = feeds.read_obs_pages(spark, landed, schema)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.collect()))
    broken = jobs.run_to_files(jobs.corrupt_stream(spark, landed, schemas.page_schema(schema)), "broken").collect()
    assert [r.line for r in broken] == ['{"data": [{"code_'] and landed in broken[0].source_file


def test_column_contract(spark):
    df = spark.createDataFrame([], "a int, b string, extra double")
    wanted = T.StructType.fromDDL("a int, b double, c date")
    got = {r.column_name: (r.expected, r.found, r.status) for r in clean.column_contract({"t": (df, wanted)}, spark).collect()}
    assert got == {"a": ("int", "int", "present"), "b": ("double", "string", "wrong type"), "c": ("date", None, "missing"), "extra": (None, "double", "not asked for")}


def test_cuts_of_large_cells_are_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=20_000)] + [(f"c{i}", float(v)) for i in range(1500) for v in (i, i + 1)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.q): r.value for r in quality.exact_quantiles(df, "v", [0.3, 0.9], K, small=500).collect()}
    hot = np.array([v for k, v in rows if k == "hot"])
    assert len(got) == 2 * 1501 and all(got["hot", q] == pytest.approx(np.quantile(hot, q), rel=1e-12) for q in (0.3, 0.9))
    assert got["c7", 0.3] == pytest.approx(7.3)
    cells = spark.createDataFrame([("hot", 0.5)], "k string, v double")
    cuts = spark.createDataFrame([("hot", [0.1], 10)], "k string, _cuts array<double>, _rows bigint")
    assert "Exchange hashpartitioning" not in quality._with_cuts(cells, cuts, K)._jdf.queryExecution().executedPlan().toString()


def test_every_lagged_regressor_is_checked(spark):
    df = daily(spark, 60, "a").withColumn("z", F.col("x") * 2)
    frame = extend_and_lag(df, K, "t", ["x", "z"], 14)
    lagged = {"x_lag14": "x", "z_lag14": "z"}

    def error(rows):
        out = quality.series_health(rows, K, "t", "level", list(lagged), lagged, 14)
        return {r["check"]: (r["value"], r["ok"]) for r in out.collect()}["lag_error"]

    assert error(frame) == (0.0, True)
    shifted = frame.withColumn("z_lag14", F.col("z_lag14") + 1)
    assert error(shifted) == (pytest.approx(1.0), False)
    assert error(frame.withColumn("z_lag14", F.when(F.col("t") > F.lit(day(50)), None).otherwise(F.col("z_lag14"))))[1] is False
