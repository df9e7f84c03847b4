import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellspan.operators import folds, frames, metrics, models, smoothing, tuning

K = ["k"]
D0 = dt.date(2015, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def frame(spark, ys, key="a", name="y"):
    return spark.createDataFrame([(key, day(i), float(y)) for i, y in enumerate(ys)], f"k string, ds date, {name} double")


def test_cutoffs_follow_the_rule(spark):
    df = frame(spark, np.zeros(1000)).unionByName(frame(spark, np.zeros(20), "short"))
    got = sorted(r.cutoff for r in folds.rolling_cutoffs(df, K, "ds", 14, 45).collect())
    want, c = [], 999 - 14
    while c >= int(0.8 * 999):
        want.append(day(c))
        c -= 45
    assert got == sorted(want)


def test_folds_never_overlap(spark):
    df = frame(spark, np.zeros(400))
    cut = folds.rolling_cutoffs(df, K, "ds", 30, 45)
    for r in folds.assign_folds(df, cut, K, 30).collect():
        assert r.train_end <= r.cutoff < r.test_start and r.n_test == 30
        assert r.n_train == (r.cutoff - D0).days + 1
    for r in folds.monthly_folds(df, K, "ds", 0.8).collect():
        assert r.n_train == (r.test_start - D0).days


def test_holdout_and_lead_split_sizes(spark):
    df = frame(spark, np.arange(100.0))
    parts = frames.holdout(df, K, "ds", ["y"], 30).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 70, "test": 30}
    led = frames.lead_frame(df, K, "ds", "y", [1, 2, 3])
    train = led.where("split = 'train'").agg(F.max("y")).first()[0]
    test = sorted(r.y for r in led.where("split = 'test'").collect())
    assert test == [93.0, 94.0, 95.0] and train == 89.0
    unpurged = frames.lead_frame(df, K, "ds", "y", [1, 2, 3], purge=False)
    assert unpurged.where("split = 'train'").agg(F.max("y")).first()[0] == 92.0


def published_smoothing(h, x, k):
    """Trailing average by horizon as published: back from the right, part of the oldest horizon."""
    g = pd.DataFrame({"h": h, "x": x}).groupby("h")["x"].agg(["sum", "count"])
    xs, ns, hs = g["sum"].to_numpy(), g["count"].to_numpy(), g.index.to_numpy()
    out, tail, sx, sn = {}, len(g) - 1, 0.0, 0
    for i in range(len(g) - 1, -1, -1):
        sx, sn = sx + xs[i], sn + ns[i]
        while sn >= k and tail >= i:
            excess = sn - k
            out[hs[tail]] = (sx - excess * xs[i] / ns[i]) / k
            sx, sn, tail = sx - xs[tail], sn - ns[tail], tail - 1
    return out


@pytest.mark.parametrize("window", [0.1, 0.25, 0.6, 1.0])
def test_horizon_metrics_equal_the_published_loop(spark, window):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(9):
        for h in range(1, 15):
            if rng.random() < 0.85:
                rows.append(("a", day(c * 45), day(c * 45 + h), float(rng.normal(10)), float(rng.normal(10))))
    df = spark.createDataFrame(rows, "k string, cutoff date, ds date, y double, yhat double")
    df = df.withColumns({"yhat_lower": F.col("yhat") - 1, "yhat_upper": F.col("yhat") + 1})
    got = {r.horizon: r for r in metrics.horizon_metrics(df, K, window).collect()}
    h = np.array([(r[2] - r[1]).days for r in rows])
    e = np.array([r[3] - r[4] for r in rows])
    k = max(int(window * len(rows)), 1)
    want = published_smoothing(h, e**2, k)
    assert set(got) == set(want)
    for t, v in want.items():
        assert got[t].rmse == pytest.approx(np.sqrt(v))
    mae = published_smoothing(h, np.abs(e), k)
    assert all(got[t].mae == pytest.approx(v) for t, v in mae.items())


def test_metrics_and_score(spark):
    df = spark.createDataFrame([("a", day(i), y, p) for i, (y, p) in enumerate([(1.0, 1.5), (2.0, 1.0), (4.0, 4.5)])], "k string, ds date, y double, yhat double")
    m = metrics.regression_metrics(df, K).first()
    assert m.r2 == pytest.approx(1 - 1.5 / (14 / 3)) and m.rmse == pytest.approx(np.sqrt(0.5)) and m.bias == pytest.approx(0.0)
    assert m.mape_pct == pytest.approx(100 * (0.5 + 0.5 + 0.125) / 3) and m.length_days == 3
    row = spark.createDataFrame([(0.7, 1.5, 1.25)], "rmse double, horizon_degradation double, rmse_mae double")
    assert metrics.select_score(row, 0.4, 0.3).first()["select_score"] == pytest.approx(0.903)


def test_flat_target_has_no_r2(spark):
    df = spark.createDataFrame([("a", day(0), 1.0, 2.0), ("a", day(1), 1.0, 0.0)], "k string, ds date, y double, yhat double")
    assert metrics.regression_metrics(df, K).first()["r2"] is None


def test_linear_fit_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    rows, want = [], {}
    for key in "ab":
        y = x @ rng.normal(size=3) + 3 + rng.normal(size=300)
        rows += [(key, *map(float, r), float(v)) for r, v in zip(x, y)]
        want[key] = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double").repartition(7)
    fitted = models.fit_linear(df, K, ["a", "b", "c"], "y")
    for r in fitted.collect():
        assert np.allclose(r.coef, want[r.k], rtol=1e-4, atol=1e-4) and r.n_train == 300
    one = models.predict_linear(df.limit(5), fitted, K, ["a", "b", "c"]).collect()
    assert all(r.yhat == pytest.approx(np.dot(want[r.k], [1, r.a, r.b, r.c]), rel=1e-6) for r in one)


def test_expanding_line_equals_polyfit(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=200), rng.normal(size=200)
    rows = [("a", day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, ds date, x double, y double")
    cut = spark.createDataFrame([("a", day(50)), ("a", day(150))], "k string, cutoff date")
    for r in models.expanding_line(df, cut, K, "x", "y").collect():
        n = (r.cutoff - D0).days + 1
        slope, intercept = np.polyfit(x[:n], y[:n], 1)
        assert (r.slope, r.intercept, r.n_train) == (pytest.approx(slope), pytest.approx(intercept), n)


def seasonal_rows(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = rng.normal(size=n)
    lagged = np.r_[np.zeros(14), x[:-14]]
    y = 100 + 0.002 * t + 3 * np.sin(2 * np.pi * t / 365.25) + 0.5 * lagged + 0.1 * rng.normal(size=n)
    return x, y


def test_additive_model_beats_climatology_and_is_calibrated(spark):
    x, y = seasonal_rows()
    rows = [("a", day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    daily = spark.createDataFrame(rows, "k string, t date, x double, level double")
    train = frames.train_frame(daily, K, "t", "level", ["x"], 14)
    cut = folds.rolling_cutoffs(train, K, "ds", 14, 45)
    configs = [{"changepoint_prior_scale": c, "seasonality_prior_scale": 10.0, "changepoint_range": 0.8} for c in (0.01, 0.3)]
    fitted = models.fit_additive(train, cut, K, ["x_lag14"], configs)
    counts = {r.cutoff: r.n_train for r in fitted.where("config_id = 0").collect()}
    assert all(n == (c - day(14)).days + 1 for c, n in counts.items())
    cv = models.backtest_additive(train, cut, K, ["x_lag14"], configs, 14).toPandas()
    assert set(cv.config_id) == {0, 1} and len(cv) == 2 * 14 * len(counts)
    err = np.sqrt(((cv.y - cv.yhat) ** 2).mean())
    assert err < 0.2
    assert 0.6 < ((cv.y >= cv.yhat_lower) & (cv.y <= cv.yhat_upper)).mean() <= 1.0


def test_one_gram_pass_equals_a_fit_on_the_fold_alone(spark):
    """A fold of the shared pass has the coefficients of a fit that only ever saw its rows."""
    x, y = seasonal_rows(900, 3)
    df = frame(spark, y)
    cut = spark.createDataFrame([("a", day(600)), ("a", day(899))], "k string, cutoff date")
    config = [{"changepoint_prior_scale": 0.1, "seasonality_prior_scale": 1.0, "changepoint_range": 0.8}]
    both = {r.cutoff: r for r in models.fit_additive(df, cut, K, [], config).collect()}
    alone = models.fit_additive(df.where(F.col("ds") <= F.lit(day(600))), cut.where(F.col("cutoff") == F.lit(day(600))), K, [], config).first()
    n = len(alone.coef)  # the shared pass has knots beyond the first cutoff, which its fold doesn't use
    assert np.allclose(np.r_[both[day(600)].coef[:33], both[day(600)].coef[-20:]], alone.coef, atol=1e-6) and n == 53
    assert not any(both[day(600)].coef[33:-20])
    assert both[day(600)].n_train == 601 and both[day(899)].n_train == 900


def test_sweep_and_refit(spark):
    x, y = seasonal_rows(1200, 1)
    rows = [(k, day(i), float(a), float(b)) for k in "ab" for i, (a, b) in enumerate(zip(x, y))]
    daily = spark.createDataFrame(rows, "k string, t date, x double, level double")
    configs = [{"changepoint_prior_scale": c, "seasonality_prior_scale": s, "changepoint_range": 0.8} for c in (0.05, 0.3) for s in (0.1, 10.0)]
    results = tuning.tune(daily, K, "t", "level", ["x"], (14, 30), configs)
    pdf = results.toPandas()
    assert len(pdf) == 2 * 2 * 4 and np.isfinite(pdf.select_score).all() and (pdf.r2 > 0.9).all()
    fc = tuning.refit_best(daily, K, "t", "level", ["x"], 14, results, configs).toPandas()
    ahead = fc[fc.y.isna()]
    assert len(ahead) == 2 * 14 and (ahead.yhat_lower < ahead.yhat).all() and (ahead.yhat < ahead.yhat_upper).all()


def holt_winters(y, period, a, b, g, phi, horizon):
    level, trend = y[:period].mean(), (y[period:2 * period].mean() - y[:period].mean()) / period
    season, sse = list(y[:period] - level), 0.0
    for v in y[period:]:
        s = season.pop(0)
        e = v - (level + phi * trend + s)
        new = a * (v - s) + (1 - a) * (level + phi * trend)
        season.append(g * (v - level - phi * trend) + (1 - g) * s)
        trend = b * (new - level) + (1 - b) * phi * trend
        level, sse = new, sse + e * e
    steps = np.cumsum(phi ** np.arange(1, horizon + 1))
    return sse, [level + steps[h] * trend + season[h % period] for h in range(horizon)]


def test_holt_winters_equals_the_recursion(spark):
    _, y = seasonal_rows(120, 5)
    y = y + np.tile([0, 2, -1, 4, 1, -3], 20)
    grid = [(a, b, g, p) for a in (0.2, 0.6) for b in (0.05, 0.3) for g in (0.1, 0.4) for p in (0.9, 1.0)]
    fits = {q: holt_winters(y, 6, *q, 9) for q in grid}
    best = min(fits, key=lambda q: fits[q][0])
    df = frame(spark, y).unionByName(frame(spark, y[:8], "short"))
    out = smoothing.holt_winters_grid(df, K, "ds", "y", 6, 9, [0.2, 0.6], [0.05, 0.3], [0.1, 0.4], [0.9, 1.0]).orderBy("step").collect()
    short = [r for r in out if r.k == "short"]
    out = [r for r in out if r.k != "short"]
    assert len(short) == 9 and all(r.yhat is None and r.reason == "8 values, two cycles have 12" for r in short)
    assert (out[0].alpha, out[0].beta, out[0].gamma, out[0].phi) == best and len(out) == 9
    assert np.allclose([r.yhat for r in out], fits[best][1])
    assert out[0].fit_rmse == pytest.approx(np.sqrt(fits[best][0] / (len(y) - 6)))


def test_run_versions_and_parameter_fallback(spark):
    new = spark.createDataFrame([("a", "r1"), ("b", "r2")], "k string, run_id string")
    history = spark.createDataFrame([("a", 1), ("a", 4)], "k string, version int")
    out = {(r.k, r.version): (r.previous_version, r.is_production) for r in tuning.register_runs(history, new, K, ["run_id"]).collect()}
    assert out == {("a", 1): (None, False), ("a", 4): (1, False), ("a", 5): (4, True), ("b", 1): (None, True)}
    three = spark.createDataFrame([("a", "r3"), ("a", "r1"), ("a", "r2")], "k string, run_id string")
    runs = tuning.register_runs(spark.createDataFrame([("a", 3)], "k string, version int"), three, K, ["run_id"]).collect()
    assert sorted((r.run_id, r.version, r.is_production) for r in runs if r.run_id) == [("r1", 4, False), ("r2", 5, False), ("r3", 6, True)]
    assert len(tuning.grid_configs()) == 15


def test_boosted_trees_learn_a_step(spark):
    rows = [("a", day(i), float(i % 7), 10.0 * (i % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t date, x double, y double")
    out = models.gbt_backtest(frames.holdout(df, K, "t", ["x", "y"], 30), K, "t", ["x"], "y", n_estimators=5, colsample=1.0)
    m = {r.split: r for r in metrics.regression_metrics(out, ["split"]).collect()}
    assert m["test"].n == 30 and m["test"].r2 > 0.8


def direct_additive(t, y, regs, cutoff, config):
    """The same model fitted directly on the training rows alone: ridge on columns standardised over them."""
    seen = t <= cutoff
    x = models._basis(t, int(t.min()), int(cutoff - t.min()), 31, (regs - regs[seen].mean(0)) / regs[seen].std(0))
    share = np.r_[np.arange(1, 32) / 32 <= config["changepoint_range"]]
    x = x[:, np.r_[True, True, share, np.ones(x.shape[1] - 33, bool)]]
    scale = np.abs(y[seen]).max()
    prior = np.r_[5, 5, np.full(share.sum(), config["changepoint_prior_scale"]), np.full(20, config["seasonality_prior_scale"]), np.full(regs.shape[1], 10.0)]

    def ridge(weights):
        a = np.vstack([x[seen], np.diag(np.sqrt(weights))])
        return np.linalg.lstsq(a, np.r_[y[seen] / scale, np.zeros(len(weights))], rcond=None)[0]

    loose = y[seen] / scale - x[seen] @ ridge(np.full(x.shape[1], 1e-9))
    return x @ ridge((loose @ loose) / seen.sum() / prior**2) * scale


def test_a_fold_equals_a_direct_fit_on_its_rows_alone(spark):
    """Later rows, ten times as large and spread, change nothing before their fold."""
    x, y = seasonal_rows(1000, 7)
    x[850:], y[850:] = x[850:] * 10 + 50, y[850:] * 10
    t = np.arange(1000) + (D0 - dt.date(1970, 1, 1)).days
    df = spark.createDataFrame([("a", day(i), float(v), float(r)) for i, (v, r) in enumerate(zip(y, x))], "k string, ds date, y double, x double")
    cut = spark.createDataFrame([("a", day(c)) for c in (700, 800)], "k string, cutoff date")
    config = {"changepoint_prior_scale": 0.3, "seasonality_prior_scale": 1.0, "changepoint_range": 0.8}
    cv = models.backtest_additive(df, cut, K, ["x"], [config], 30).toPandas()
    first = cv[cv.cutoff == day(700)].sort_values("ds")
    assert np.allclose(first.yhat, direct_additive(t, y, x[:, None], t[700], config)[701:731], rtol=1e-7)
    later = df.where(F.col("ds") <= F.lit(day(840)))
    again = models.backtest_additive(later, cut, K, ["x"], [config], 30).toPandas()
    both = cv.merge(again, on=["cutoff", "ds"])
    assert len(both) == 60 and np.allclose(both.yhat_x, both.yhat_y, rtol=1e-9) and np.allclose(both.yhat_lower_x, both.yhat_lower_y, rtol=1e-9)


def test_sweep_sums_equal_the_sums_of_the_backtest(spark):
    x, y = seasonal_rows(900, 4)
    rows = [(k, day(i), float(v) * s, float(r)) for k, s in (("a", 1), ("b", 0)) for i, (v, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "k string, ds date, y double, x double").withColumn("h", F.lit(14))
    by = ["k", "h"]
    cut = folds.rolling_cutoffs(df, by, "ds", F.col("h"), 45)
    configs = [{"changepoint_prior_scale": c, "seasonality_prior_scale": 1.0, "changepoint_range": r} for c in (0.05, 0.3) for r in (0.8, 0.95)]
    cv = models.backtest_additive(df, cut, by, ["x"], configs, "h")
    want = metrics.horizon_sums(cv, [*by, "config_id"]).toPandas().sort_values(["k", "config_id", "horizon"])
    got = models.sweep_sums(df, cut, by, ["x"], configs, "h").toPandas().sort_values(["k", "config_id", "horizon"])[want.columns]
    assert len(want) == 2 * 4 * 14
    for c in want.columns[3:]:
        assert np.allclose(want[c].astype(float), got[c].astype(float), equal_nan=True), c


def test_stations_without_rows_or_cutoffs(spark):
    _, y = seasonal_rows(400, 2)
    df = frame(spark, y).unionByName(frame(spark, y, "no cutoff")).unionByName(frame(spark, [float("nan")] * 3, "no level").replace(float("nan"), None))
    cut = spark.createDataFrame([("a", day(300)), ("no level", day(2)), ("no rows", day(2))], "k string, cutoff date")
    config = [{"changepoint_prior_scale": 0.1, "seasonality_prior_scale": 1.0, "changepoint_range": 0.8}]
    got = {r.k: r.error for r in models.fit_additive(df, cut, K, [], config).collect()}
    assert got == {"a": None, "no level": "no training rows", "no rows": "no training rows"}
    assert {r.k for r in models.backtest_additive(df, cut, K, [], config, 14).collect()} == {"a"}


def test_intervals_from_backtest_errors(spark):
    rows = [("a", day(c), day(c + h), h, 10.0 + e * h, 10.0) for c, e in enumerate((-2.0, -1.0, 0.0, 1.0, 3.0)) for h in (1, 2)]
    cv = spark.createDataFrame(rows, "k string, cutoff date, ds date, horizon int, y double, yhat double")
    fc = spark.createDataFrame([("a", day(100 + i), None, 7.0, 1.0, 0, day(100), 90) for i in range(4)],
                               "k string, ds date, y double, yhat double, sigma double, config_id int, cutoff date, n_train bigint")
    got = {r.horizon: r for r in models.with_tested_interval(fc, models.error_quantiles(cv, K, 0.5), K, 0.5).collect()}
    assert (got[1].yhat_lower, got[1].yhat_upper, got[1].n_errors, got[1].interval_from) == (6.0, 8.0, 5, "backtest")
    assert (got[2].yhat_lower, got[2].yhat_upper) == (5.0, 9.0)
    assert got[0].interval_from == got[3].interval_from == "fit" and got[3].yhat_upper == pytest.approx(7 + models.interval_z(0.5))
