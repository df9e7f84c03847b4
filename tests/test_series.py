import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from wellspan import schemas
from wellspan.operators import calendar as cal, clean, decompose, events, indices, joins, lagcorr, quality, rolling
from wellspan.plans.features import feature_table

K = ["k"]
D0 = dt.date(2020, 1, 1)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def day(n):
    return D0 + dt.timedelta(days=n)


def series(spark, xs, start=0, key="a"):
    return spark.createDataFrame([(key, day(start + i), x) for i, x in enumerate(xs)], "k string, t date, x double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def monthly_series(spark, xs, first=(2000, 1)):
    rows = []
    for i, x in enumerate(xs):
        y, m = divmod(first[0] * 12 + first[1] - 1 + i, 12)
        rows.append(("a", dt.date(y, m + 1, 1), x))
    return spark.createDataFrame(rows, "k string, t date, x double")


def test_interpolation_golden(spark):
    rows = [("a", day(0), None), ("a", day(1), 1.0), ("a", day(4), None), ("a", day(5), 4.0), ("a", day(6), None)]
    df = spark.createDataFrame(rows, "k string, t date, x double")
    assert column(clean.interpolate_linear(df, K, "t", ["x"]), "x") == [None, 1.0, 3.25, 4.0, 4.0]


@SLOW
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=2, max_size=40))
def test_interpolation_equals_pandas(spark, xs):
    got = column(clean.interpolate_linear(series(spark, xs), K, "t", ["x"]), "x")
    want = pd.Series(xs, dtype=float).interpolate()
    assert np.allclose(np.array(got, dtype=float), want, equal_nan=True)
    assert all(g == x for g, x in zip(got, xs) if x is not None)


def test_monthly_resample_keeps_empty_months(spark):
    rows = [("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 2, 5), None), ("a", dt.date(2020, 4, 5), 3.0)]
    df = spark.createDataFrame(rows, "k string, t date, x double").withColumns({"m": F.col("x"), "l": F.col("x")})
    out = cal.monthly(df, K, "t", {"x": "sum", "m": "mean", "l": "last"})
    assert column(out, "x", "month") == [1.0, 0.0, 0.0, 3.0]
    assert column(out, "m", "month") == [1.0, None, None, 3.0]
    assert column(out, "l", "month") == [1.0, None, None, 3.0]


def test_rolling_sum_and_centred_mean(spark):
    w = Window.partitionBy("k").orderBy("t")
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    assert column(df.withColumn("s", rolling.rolling_sum(F.col("x"), 2, w)), "s") == [None, 3.0, None, None, 9.0, 11.0]
    df = series(spark, [float(i) for i in range(6)])
    assert column(df.withColumn("c", rolling.rolling_centered(F.col("x"), 3, w)), "c") == [None, 1, 2, 3, 4, None]
    assert column(df.withColumn("c", rolling.rolling_centered(F.col("x"), 4, w)), "c") == [None, None, 1.5, 2.5, 3.5, None]


@pytest.mark.parametrize("n", [3, 4, 7])
def test_running_sum_form_of_the_centred_mean(spark, n):
    rng = np.random.default_rng(n)
    xs = [None if rng.random() < 0.1 else float(x) for x in 1e5 + rng.normal(size=60)]
    w = Window.partitionBy("k").orderBy("t")
    df = series(spark, xs).withColumn("a", rolling.rolling_centered(F.col("x"), n, w))
    out = rolling.with_centered_mean(df, K, "t", "x", n, "b")
    got, want = (np.array(column(out, c), dtype=float) for c in "ba")
    assert np.allclose(got, want, rtol=1e-13, equal_nan=True)


def test_stepwise_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    xs = [None if rng.random() < 0.03 else float(x) for x in rng.integers(0, 9, 150)]
    w = Window.partitionBy("k").orderBy("t")
    windows = (2, 7, 12, 30, 60)
    df = series(spark, xs)
    out = rolling.rolling_sums(df, K, "t", {"s": F.col("x")}, windows)
    for n in windows:
        assert column(out, f"s_{n}") == column(df.withColumn("r", rolling.rolling_sum(F.col("x"), n, w)), "r")


def test_densify_covers_gaps_and_the_extension(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 2.0), ("b", day(9), 5.0)], "k string, t date, x double")
    out = cal.densify(df, K, "t", extra=2).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.x) for r in out] == [
        ("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), None), ("a", day(3), 2.0), ("a", day(4), None),
        ("a", day(5), None), ("b", day(9), 5.0), ("b", day(10), None), ("b", day(11), None),
    ]
    assert column(cal.missing_dates(df, K, "t"), "t") == [day(1), day(2)]


def test_lag_equals_the_value_h_days_before(spark):
    df = spark.createDataFrame([("a", day(i), float(i)) for i in (0, 1, 4, 7)], "k string, t date, x double")
    out = {r.t: r.x_lag3 for r in rolling.extend_and_lag(df, K, "t", ["x"], 3).collect()}
    assert out[day(3)] == 0.0 and out[day(4)] == 1.0 and out[day(7)] == 4.0 and out[day(10)] == 7.0 and out[day(6)] is None


def test_upsert_and_dedupe(spark):
    old = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 2.0)], "k string, t date, x double")
    new = spark.createDataFrame([("a", day(1), 9.0), ("a", day(2), 3.0)], "k string, t date, x double")
    assert column(clean.upsert_last(old, new, ["k", "t"]), "x") == [1.0, 9.0, 3.0]
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 5, "z")], "k string, seq int, v string")
    first = {r.k: (r.seq, r.v) for r in clean.dedupe_first(rows, ["k"], ["seq"]).collect()}
    assert first == {"a": (1, None), "b": (5, "z")}


def test_fill_first_valid_also_fills_interior(spark):
    df = series(spark, [None, 3.0, None, 5.0])
    assert column(clean.fill_first_valid(df, K, "t", ["x"]), "x") == [3.0, 3.0, 3.0, 5.0]


def test_gringorten_small_groups_and_ties(spark):
    for xs, want in (([7.0], [0.0]), ([1.0, 2.0], [-0.630600, 0.630600]), ([1.0, 2.0, 3.0], [-0.917321, 0, 0.917321])):
        df = monthly_series(spark, [v for x in xs for v in [x] + [None] * 11])
        z = [v for v in column(indices.normal_score(df, "x", ["k", F.month("t")]), "z") if v is not None]
        assert z == pytest.approx(want, abs=1e-6)
    ties = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 5.0), ("a", None)], "k string, x double")
    ranks = ties.withColumn("r", indices.rank_avg(F.col("x"), ["k"]))
    assert [r.r for r in ranks.orderBy("x").collect()] == [None, 1.0, 2.5, 2.5]


@SLOW
@given(st.lists(st.integers(-1000, 1000), min_size=24, max_size=60))
def test_index_is_invariant_under_increasing_transforms(spark, xs):
    df = monthly_series(spark, [float(x) for x in xs]).withColumn("y", F.col("x") * F.col("x") * F.col("x") + 7)
    a = column(indices.standardized_index(df, K, "t", "x"), "z", "month")
    b = column(indices.standardized_index(df, K, "t", "y"), "z", "month")
    assert a == b


def test_panel_agrees_with_single_indices(spark):
    rng = np.random.default_rng(3)
    rows = [("a", day(i), float(rng.normal()), float(rng.gamma(2))) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, t date, level double, rain double")
    specs = [schemas.IndexSpec("SPLI", "level", "mean"), schemas.IndexSpec("SPI", "rain", "sum")]
    panel = indices.index_panel(df, K, "t", specs, (1, 3))
    for s in specs:
        for scale in (1, 3):
            one = column(indices.standardized_index(df, K, "t", s.column, s.agg, scale), "z", "month")
            part = panel.where((F.col("index_name") == s.name) & (F.col("scale") == scale))
            assert column(part, "z", "month") == one
    wide = indices.pivot_panel(panel, K, ["SPLI-1", "SPI-3"])
    assert wide.columns == ["k", "month", "SPLI-1", "SPI-3"]


def test_pool_score(spark):
    df = spark.createDataFrame([(1, 1, 4)], "less int, equal int, pool int")
    assert indices.pool_score(df, "less", "equal", "pool").first()["z"] == pytest.approx(-0.247285, abs=1e-6)


def test_forecast_index_needs_more_than_fourteen_days(spark):
    obs = [("a", dt.date(y, m, d), float(y + d)) for y in (2018, 2019) for m in (1, 2) for d in range(1, 29)]
    obs += [("a", dt.date(2020, 1, d), 2019.0 + d) for d in range(1, 32)]
    seen = spark.createDataFrame(obs, "k string, ds date, y double")
    last = spark.createDataFrame([("a", dt.date(2020, 1, 31))], "k string, last_train date")
    for days, rows in ((14, 0), (15, 1)):
        fc = spark.createDataFrame([("a", dt.date(2020, 2, d), 2021.0 + d) for d in range(1, days + 1)], "k string, ds date, yhat double")
        assert indices.forecast_index(seen, fc, last, K).count() == rows


def run_events(xs, thr, direction, min_gap, pooling):
    """The event rules as a plain loop."""
    hit = [x < thr if direction == "below" else x > thr for x in xs]
    runs, i = [], 0
    while i < len(xs):
        if hit[i]:
            j = i
            while j + 1 < len(xs) and hit[j + 1]:
                j += 1
            if pooling and runs and i - runs[-1][1] <= min_gap:
                runs[-1][1] = j
            else:
                runs.append([i, j])
            i = j
        i += 1
    out = []
    for a, b in runs:
        w = np.array(xs[a:b + 1])
        d = np.clip(thr - w if direction == "below" else w - thr, 0, None)
        peak = w.min() if direction == "below" else w.max()
        out.append((a, b, len(w), round(peak, 2), round(d.sum(), 2), a + int(np.argmin(w) if direction == "below" else np.argmax(w))))
    return out


@SLOW
@given(
    st.lists(st.sampled_from([-2.5, -2.0, -1.6, -1.0, 0.0, 0.7, 1.8]), min_size=3, max_size=30),
    st.sampled_from(["below", "above"]), st.integers(1, 3), st.booleans(),
)
def test_events_equal_the_loop(spark, xs, direction, min_gap, pooling):
    thr = -1.5 if direction == "below" else 0.5
    df = monthly_series(spark, xs)
    got = events.characterize_events(df, K, "t", "x", thr, direction, min_gap, pooling).orderBy("start").collect()
    index = {r.t: i for i, r in enumerate(df.orderBy("t").collect())}
    have = [(index[r.start], index[r.end], r.duration_m, r.peak, r.severity, index[r.peak_date]) for r in got]
    want = run_events(xs, thr, direction, min_gap, pooling)
    assert [h[:3] + h[5:] for h in have] == [w[:3] + w[5:] for w in want]
    assert [h[3:5] for h in have] == [pytest.approx(w[3:5], abs=0.011) for w in want]
    hits = sum(x < thr if direction == "below" else x > thr for x in xs)
    total = sum(h[2] for h in have)
    assert total >= hits and (pooling or total == hits)


def test_pooling_golden(spark):
    df = monthly_series(spark, [-2.0, -0.5, -2.0, 0.0, 0.0, -1.6])
    assert events.characterize_events(df, K, "t", "x", -1.5, min_gap=1).count() == 3
    pooled = events.characterize_events(df, K, "t", "x", -1.5, min_gap=2).orderBy("start").collect()
    assert len(pooled) == 2 and pooled[0].duration_m == 3 and pooled[0].severity == 1.0


def test_heatwaves_equal_numpy(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = 20 + 8 * np.sin(np.arange(n) / 58) + rng.normal(0, 3, n)
    idx = pd.date_range(D0, periods=n)
    doy = idx.dayofyear.to_numpy()
    thr = np.empty(n)
    for i, d in enumerate(doy):
        near = np.abs(doy - d)
        thr[i] = np.percentile(x[np.minimum(near, 366 - near) <= 15], 90)
    hot = pd.Series(x > thr)
    size = hot.groupby((hot != hot.shift()).cumsum()).transform("size")
    want = (hot & (size >= 3)).tolist()
    out = events.heatwave_days(series(spark, x.tolist()), K, "t", "x").orderBy("t").collect()
    assert [r.heatwave for r in out] == want
    assert np.allclose([r.threshold for r in out], thr)


def test_lag_correlation_golden(spark):
    rows = [("a", day(i), float(a), float(b)) for i, (a, b) in enumerate(zip([1, 2, 3, 5, 4], [2, 1, 4, 3, 5]))]
    df = spark.createDataFrame(rows, "k string, t date, a double, b double")
    out = lagcorr.cross_correlation(df, K, "t", "a", "b", 4)
    assert column(out, "r", "lag") == [
        pytest.approx(0.6), pytest.approx(0.8286, abs=1e-4), pytest.approx(0.5), pytest.approx(1.0), None,
    ]
    assert lagcorr.best_lag(out, K).first()["lag"] == 3


def test_asof_takes_the_latest_known_month(spark):
    daily = series(spark, [0.0] * 70)
    panel = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.5), ("a", dt.date(2020, 3, 1), 2.5)], "k string, month date, z double")
    z = column(joins.asof_month(daily, panel, K, "t", ["z"]), "z")
    assert z[:60] == [1.5] * 60 and z[60:] == [2.5] * 10


def test_decomposition_recovers_season(spark):
    n = 12 * 12
    season = np.sin(2 * np.pi * np.arange(n) / 12)
    xs = 0.01 * np.arange(n) + season
    xs[50] += 40  # one outlier the robust version has to shrug off
    df = monthly_series(spark, xs.tolist())
    parts = decompose.decompose_robust(df, K, "t", "x", 12).orderBy("t").collect()
    assert np.allclose([p.seasonal for p in parts], season, atol=0.05)
    assert parts[50].weight == 0.0 and parts[50].resid > 35
    assert np.allclose([p.trend + p.seasonal + p.resid for p in parts], xs)


def test_exact_quantiles_equal_numpy_on_hard_shapes(spark):
    rng = np.random.default_rng(1)
    shapes = {
        "same": np.full(50, 3.0), "two": np.array([1.0, 2.0]), "one": np.array([5.0]),
        "skewed": np.concatenate([rng.exponential(1e-6, 500), [1e9]]), "repeats": rng.integers(0, 4, 300).astype(float),
    }
    rows = [(k, float(v)) for k, xs in shapes.items() for v in xs]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    out = quality.exact_quantiles(df, "x", probs, K, bins=8, small=4).collect()
    got = {(r.k, r.q): r.value for r in out}
    for k, xs in shapes.items():
        for q in probs:
            assert got[(k, q)] == pytest.approx(np.quantile(xs, q), rel=1e-12), (k, q)


def test_null_profile_and_corr_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 0.5)], "a double, b double")
    row = {r["column"]: (r.n_null, r.pct_null) for r in quality.null_profile(df, ["a", "b"]).collect()}
    assert row == {"a": (0, 0.0), "b": (1, 25.0)}
    r = {(x.var1, x.var2): x.r for x in quality.corr_matrix(df, ["a", "b"]).collect()}
    want = pd.DataFrame({"a": [1, 2, 3, 4], "b": [2, np.nan, 1, .5]}).corr().loc["a", "b"]
    assert r[("a", "b")] == r[("b", "a")] == pytest.approx(want) and r[("a", "a")] == pytest.approx(1.0)


def test_required_columns_raise_before_any_job(spark):
    with pytest.raises(KeyError, match="missing columns"):
        clean.require_columns(spark.range(1), ["id", "level"])


def test_cleaning_drops_the_listed_columns(spark):
    weather = spark.createDataFrame([], schemas.WEATHER_SCHEMA)
    out = clean.clean_weather(weather)
    assert "date_index" in out.columns and len(out.columns) == len(weather.columns) - 19 + 1
    obs = clean.clean_obs(spark.createDataFrame([], schemas.OBSERVATION_SCHEMA))
    assert set(obs.columns) == {"code_bss", "bss_id", "niveau_nappe_eau", "mode_obtention", "nom_producteur", "date_index"}


def test_feature_table_against_pandas(spark):
    """One station, the whole processed table, against the same steps in pandas."""
    rng = np.random.default_rng(11)
    n = 800
    t = pd.date_range("2019-01-01", periods=n)
    keep = np.sort(rng.choice(n, 760, replace=False))
    names = {
        "niveau_nappe_eau": rng.normal(104, 1, n), "precipitation_sum": rng.gamma(1, 3, n).round(1),
        "et0_fao_evapotranspiration": rng.gamma(2, 1, n).round(2), "soil_temperature_0_to_100cm_mean": rng.normal(15, 5, n),
        "shortwave_radiation_sum": rng.gamma(3, 4, n), "wind_speed_10m_mean": rng.gamma(3, 2, n),
        "cloud_cover_mean": rng.uniform(0, 100, n), "pressure_msl_mean": rng.normal(1013, 8, n),
        "soil_moisture_0_to_100cm_mean": rng.uniform(0, .4, n),
    }
    pdf = pd.DataFrame(names, index=t).iloc[keep]
    pdf.iloc[rng.choice(len(pdf), 60, replace=False), 0] = np.nan
    rows = [("a", i.date(), *[None if np.isnan(v) else float(v) for v in r]) for i, r in zip(pdf.index, pdf.to_numpy())]
    df = spark.createDataFrame(rows, "code_bss string, date_index date, " + ", ".join(f"{c} double" for c in names))
    got = feature_table(df, ["code_bss"], "date_index").toPandas().set_index("date_index").sort_index()

    want = pdf.copy()
    want[:] = pdf.asfreq("D").interpolate().loc[pdf.index]
    rain, et0 = want["precipitation_sum"], want["et0_fao_evapotranspiration"]
    for w in (30, 90):
        want[f"P_cum_{w}d"] = rain.rolling(w).sum()
        want[f"Peff_cum_{w}d"] = (rain - et0).rolling(w).sum()
        want[f"Temperature_mean_{w}d"] = want["soil_temperature_0_to_100cm_mean"].rolling(w).mean().round(2)
    for c in [c for c in want if "_cum_" in c or c.startswith("Temperature_mean")]:
        want[c] = want[c].fillna(want[c].dropna().iloc[0])
    from statistics import NormalDist
    want["Peff"] = rain - et0
    for s in schemas.INDEX_SPECS:
        m = want[s.column].resample("MS").agg(s.agg)
        g = m.groupby(m.index.month)
        p = (g.rank() - 0.44) / (g.transform("count") + 0.12)
        z = p.map(NormalDist().inv_cdf)
        want[s.name] = z.reindex(want.index.to_period("M").to_timestamp()).to_numpy()
    want = want.drop(columns="Peff")
    assert len(got) == len(want)
    for c in want.columns:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=0.0101 if c.startswith("Temperature_mean") else 1e-6), c
