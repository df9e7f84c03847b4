"""Queries on modelling frames, folds, forecasts and their evaluation."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import Window, functions as F

from wellspan import schemas
from wellspan.operators import folds, frames, metrics, models, quality, smoothing, tuning
from wellspan.operators.clean import conform_daily, select_regex
from wellspan.operators.decompose import decompose_robust
from wellspan.operators.indices import pivot_panel
from wellspan.operators.rolling import extend_and_lag, water_balance_features
from wellspan.plans import retrain
from wellspan.plans.additive_sql import additive_sql
from wellspan.plans.baselines import naive_backtest
from wellspan.plans.index_queries import CONFORMED, FORECAST_POOL, NAMES, PANEL_SQL, SEVERITY_LIMITS, first_filled, level_index, panel_of, sixteenths
from wellspan.plans.quality_queries import INTERPOLATED, _robust_pass, dense_levels, robust_sql
from wellspan.plans.registry import MERGED, OBS, SPLI, calendar, ppf_sql, q6, query, r6, with_
from wellspan.session import reuse, scratch_path
from wellspan.sources import panels, zones
from wellspan.sources.feeds import union_frames

K = ["station"]
REGRESSORS = ["radiation", "et0", "soil_temp", "P_cum_90d", "Peff_cum_90d", "Temperature_mean_90d"]
SIMPLE = ["radiation", "et0", "soil_temp"]


def model_daily(spark, sf_dir):
    """Conformed daily table with the six regressors of the forecaster."""
    return features_of(panels.merged(spark, sf_dir))


def features_of(merged):
    daily = conform_daily(sixteenths(merged), K, "t")
    daily = water_balance_features(daily, K, "t", "precip", "et0", "soil_temp", windows=(90,))
    return daily.select("station", "t", "level", *REGRESSORS)


_ROLLED = REGRESSORS[3:]
DAILY = f"""{CONFORMED}, rolled AS (SELECT *, {', '.join(map(first_filled, _ROLLED))} FROM (SELECT *, precip - et0 AS Peff FROM merged)),
daily AS (SELECT station, t, level, {', '.join(SIMPLE)}, {', '.join(f"COALESCE({c}, FIRST_VALUE({c} IGNORE NULLS) OVER w) AS {c}" for c in _ROLLED)} FROM rolled
  WINDOW w AS (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def lagged_sql(h: int, src: str = "daily", out: str = "fr") -> str:
    """Complete rows of the lagged frame: history and ``h`` days beyond, regressors ``h`` days old."""
    return f"""{calendar(src, f'{out}_cal', extra=h)},
{out} AS (SELECT c.station, c.t AS ds, m.level AS y, {', '.join(f'w.{c}' for c in REGRESSORS)} FROM {out}_cal c
  JOIN {src} w ON w.station = c.station AND w.t = c.t - {h} LEFT JOIN {src} m ON m.station = c.station AND m.t = c.t
  WHERE {' AND '.join(f'w.{c} IS NOT NULL' for c in REGRESSORS)})"""


# --- frames ------------------------------------------------------------------------------

def _frame_sql(h: int, need_y: bool) -> str:
    lagged = ", ".join(f"{q6(c, 3)} AS {c}_lag{h}" for c in REGRESSORS)
    return f"""WITH {DAILY}, {lagged_sql(h)} SELECT station, ds, {q6('y', 3)} AS y, {lagged} FROM fr {'WHERE y IS NOT NULL' if need_y else ''}"""


def _frame(make, spark, sf_dir, h):
    frame = make(model_daily(spark, sf_dir), K, "t", "level", REGRESSORS, h)
    return frame.withColumns({c: r6(c, 3) for c in ["y", *frames.lag_names(REGRESSORS, h)]})


@query("train_frame_h14", _frame_sql(14, True))
def train_frame_h14(spark, sf_dir):
    return _frame(frames.train_frame, spark, sf_dir, 14)


@query("train_frame_h30", _frame_sql(30, True))
def train_frame_h30(spark, sf_dir):
    return _frame(frames.train_frame, spark, sf_dir, 30)


@query("future_frame_h14", _frame_sql(14, False))
def future_frame_h14(spark, sf_dir):
    return _frame(frames.future_frame, spark, sf_dir, 14)


@query("future_frame_h30", _frame_sql(30, False))
def future_frame_h30(spark, sf_dir):
    return _frame(frames.future_frame, spark, sf_dir, 30)


@query("feature_target_split", f"""WITH {DAILY}, {lagged_sql(14)} SELECT side, "column", COUNT(*) AS n, {q6('AVG(v)', 3)} AS mean FROM (
  {' UNION ALL '.join(f"SELECT 'feature' AS side, '{c}_lag14' AS \"column\", {c} AS v FROM fr WHERE y IS NOT NULL" for c in REGRESSORS)} UNION ALL SELECT 'target', 'y', y FROM fr WHERE y IS NOT NULL) GROUP BY 1, 2""")
def feature_target_split(spark, sf_dir):
    """What goes into a model and what it is to say, column by column."""
    frame = reuse(frames.train_frame(model_daily(spark, sf_dir), K, "t", "level", REGRESSORS, 14))
    sides = zip(("feature", "target"), frames.feature_target(frame, frames.lag_names(REGRESSORS, 14), "y"))
    parts = [F.struct(F.lit(side).alias("side"), F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean")) for side, df in sides for c in df.columns]
    return frame.agg(F.array(*parts).alias("p")).select(F.inline("p")).withColumn("mean", r6("mean", 3))


_INDEX_COLUMNS = [n for n in NAMES if n.startswith("S") and n.endswith("I")]


@query("index_columns_monthly_mean", f"""WITH {PANEL_SQL}, w AS (SELECT station, month, {', '.join(f"MAX(CASE WHEN index_name = '{n}' THEN z END) AS {n}" for n in _INDEX_COLUMNS)} FROM panel WHERE scale = 1 GROUP BY 1, 2)
SELECT month, {', '.join(f"{q6(f'AVG({n})')} AS {n}" for n in _INDEX_COLUMNS)} FROM w GROUP BY 1""")
def index_columns_monthly_mean(spark, sf_dir):
    """Every index column, picked by its name pattern, averaged over stations by month."""
    wide = pivot_panel(panel_of(spark, sf_dir, (1,)), K, NAMES, scale=1)
    picked = select_regex(wide).columns
    return wide.groupBy("month").agg(*[r6(F.avg(c)).alias(c) for c in picked])


_MONTHLY_REGRESSORS = ["SSMI", "SPEI", "SPI", "SSTI"]
_WIDE = f"""{PANEL_SQL}, pw AS (SELECT station, month, {', '.join(f"MAX(CASE WHEN index_name = '{n}' THEN z END) AS {n}" for n in ('SPLI', *_MONTHLY_REGRESSORS))}
  FROM panel WHERE scale = 1 GROUP BY 1, 2)"""


@query("monthly_regressor_frame", f"""WITH {_WIDE}
SELECT p.station, CAST(p.month + INTERVAL 3 MONTH AS DATE) AS ds, {q6('y.SPLI')} AS y, {', '.join(f"{q6(f'p.{n}')} AS {n}_lag3" for n in _MONTHLY_REGRESSORS)}
FROM pw p LEFT JOIN pw y ON y.station = p.station AND y.month = CAST(p.month + INTERVAL 3 MONTH AS DATE)
WHERE {' AND '.join(f'p.{n} IS NOT NULL' for n in _MONTHLY_REGRESSORS)}""")
def monthly_regressor_frame(spark, sf_dir):
    wide = pivot_panel(panel_of(spark, sf_dir, (1,)), K, ["SPLI", *_MONTHLY_REGRESSORS], scale=1)
    frame = frames.future_frame(wide, K, "month", "SPLI", _MONTHLY_REGRESSORS, 3, "month")
    return frame.select("station", "ds", *[r6(c).alias(c) for c in frame.columns[2:]])


@query("monthly_lead_frame", f"""WITH {SPLI}, n AS (SELECT station, month, z, ROW_NUMBER() OVER (PARTITION BY station ORDER BY month DESC) AS back FROM spli)
SELECT a.station, a.month, {q6('a.z')} AS z, {', '.join(f"{q6(f'(SELECT b.z FROM n b WHERE b.station = a.station AND b.back = a.back - {i})')} AS z_{i}m" for i in (1, 2, 3))},
  CASE WHEN back > 10 THEN 'train' ELSE 'test' END AS split FROM n a WHERE back > 10 OR back BETWEEN 5 AND 7""")
def monthly_lead_frame(spark, sf_dir):
    rows = level_index(spark, sf_dir).select("station", "month", "z")
    out = frames.lead_frame(rows, K, "month", "z", [1, 2, 3])
    return out.withColumns({c: r6(c) for c in ("z", "z_1m", "z_2m", "z_3m")})


@query("holdout_split", f"""{with_(MERGED)}, c AS (SELECT station, t, level, precip FROM merged WHERE level IS NOT NULL),
k AS (SELECT station, t FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY station ORDER BY t DESC) = 30)
SELECT c.station, c.t, c.level, c.precip, CASE WHEN c.t >= k.t THEN 'test' ELSE 'train' END AS split FROM c JOIN k ON k.station = c.station""")
def holdout_split(spark, sf_dir):
    return frames.holdout(panels.merged(spark, sf_dir), K, "t", ["level", "precip"], 30)


# --- folds -------------------------------------------------------------------------------

@query("walk_forward_folds", f"""{with_(OBS)}, p AS (SELECT station, t, ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) AS pos, COUNT(*) OVER (PARTITION BY station) AS n FROM obs),
f AS (SELECT station, CAST(date_trunc('month', t) AS DATE) AS month, MIN(t) AS test_start, MAX(t) AS test_end, COUNT(*) AS n_test FROM p WHERE pos > floor(n * 0.8) GROUP BY 1, 2)
SELECT f.*, (SELECT COUNT(*) FROM obs o WHERE o.station = f.station AND o.t < f.test_start) AS n_train,
  CAST(ROW_NUMBER() OVER (PARTITION BY station ORDER BY month) AS INTEGER) AS fold FROM f""")
def walk_forward_folds(spark, sf_dir):
    return folds.monthly_folds(panels.obs(spark, sf_dir), K, "t", 0.8)


@query("folds_from_date", f"""{with_(OBS)}, f AS (SELECT station, CAST(date_trunc('month', t) AS DATE) AS month, MIN(t) AS test_start, MAX(t) AS test_end, COUNT(*) AS n_test
  FROM obs WHERE t >= DATE '2000-10-01' GROUP BY 1, 2)
SELECT f.*, (SELECT COUNT(*) FROM obs o WHERE o.station = f.station AND o.t < f.test_start) AS n_train,
  CAST(ROW_NUMBER() OVER (PARTITION BY station ORDER BY month) AS INTEGER) AS fold FROM f""")
def folds_from_date(spark, sf_dir):
    return folds.folds_from(panels.obs(spark, sf_dir), K, "t", dt.date(2000, 10, 1))


@query("fold_of_one_month", f"""{with_(OBS)} SELECT o.station, DATE '2001-01-01' AS month, MIN(t) AS test_start, MAX(t) AS test_end, COUNT(*) AS n_test,
  (SELECT COUNT(*) FROM obs b WHERE b.station = o.station AND b.t < MIN(o.t)) AS n_train, 1 AS fold FROM obs o WHERE t BETWEEN DATE '2001-01-01' AND DATE '2001-01-31' GROUP BY 1""")
def fold_of_one_month(spark, sf_dir):
    """A single fixed test month, trained on everything before it."""
    return folds.folds_from(panels.obs(spark, sf_dir), K, "t", dt.date(2001, 1, 1), dt.date(2001, 1, 31))


def _cut_sql(src: str, h: int, period: int, out: str = "cuts", ds: str = "t") -> str:
    return f"""{out}_r AS (SELECT station, MIN({ds}) AS a, MAX({ds}) AS b FROM {src} GROUP BY 1),
{out} AS (SELECT station, CAST(b - {h} - CAST(i * {period} AS INTEGER) AS DATE) AS cutoff FROM {out}_r, (SELECT range AS i FROM range(0, 400))
  WHERE b - {h} - CAST(i * {period} AS INTEGER) >= a + CAST(floor((b - a) * 0.8) AS INTEGER))"""


@query("rolling_origin_cutoffs", f"{with_(OBS, _cut_sql('obs', 14, 45))} SELECT station, cutoff FROM cuts")
def rolling_origin_cutoffs(spark, sf_dir):
    return folds.rolling_cutoffs(panels.obs(spark, sf_dir), K, "t", 14, schemas.CV_PERIOD_DAYS)


@query("fold_assignment", f"""{with_(OBS, _cut_sql('obs', 30, 45))} SELECT c.station, c.cutoff,
  (SELECT COUNT(*) FROM obs o WHERE o.station = c.station AND o.t <= c.cutoff) AS n_train,
  (SELECT MAX(t) FROM obs o WHERE o.station = c.station AND o.t <= c.cutoff) AS train_end,
  (SELECT COUNT(*) FROM obs o WHERE o.station = c.station AND o.t > c.cutoff AND o.t <= c.cutoff + 30) AS n_test,
  (SELECT MIN(t) FROM obs o WHERE o.station = c.station AND o.t > c.cutoff AND o.t <= c.cutoff + 30) AS test_start,
  (SELECT MAX(t) FROM obs o WHERE o.station = c.station AND o.t > c.cutoff AND o.t <= c.cutoff + 30) AS test_end FROM cuts c""")
def fold_assignment(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir).withColumnRenamed("t", "ds"))
    cutoffs = folds.rolling_cutoffs(daily, K, "ds", 30, schemas.CV_PERIOD_DAYS)
    return folds.assign_folds(daily, cutoffs, K, 30)


@query("picked_folds", f"""{with_(OBS, _cut_sql('obs', 14, 7))}, n AS (SELECT station, cutoff, ROW_NUMBER() OVER (PARTITION BY station ORDER BY cutoff) - 1 AS i, COUNT(*) OVER (PARTITION BY station) AS n FROM cuts)
SELECT station, cutoff FROM n WHERE i % greatest(1, n // 14) = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY station ORDER BY cutoff) <= 14""")
def picked_folds(spark, sf_dir):
    cutoffs = folds.rolling_cutoffs(panels.obs(spark, sf_dir), K, "t", 14, 7)
    return folds.pick_folds(cutoffs, K, 14)


# --- backtests and metrics ----------------------------------------------------------------

Z80 = models.interval_z(0.80)


def naive_cv(spark, sf_dir, h=14):
    dense = reuse(dense_levels(spark, sf_dir).select("station", F.col("t").alias("ds"), F.col("level").alias("y")))
    cutoffs = folds.rolling_cutoffs(dense, K, "ds", h, schemas.CV_PERIOD_DAYS)
    return dense, naive_backtest(dense, cutoffs, K, h, Z80)


def _naive_sql(h: int) -> str:
    base = "SELECT c.station, '{m}' AS model, c.cutoff, d.t AS ds, d.y, {yhat} AS yhat, s.sd FROM cuts c JOIN dense d ON d.station = c.station AND d.t > c.cutoff AND d.t <= c.cutoff + " + str(h) + " JOIN sd s ON s.station = c.station AND s.cutoff = c.cutoff"
    last = base.format(m="last_value", yhat="(SELECT x.y FROM dense x WHERE x.station = c.station AND x.t = c.cutoff)")
    season = base.format(m="seasonal_naive", yhat="(SELECT x.y FROM dense x WHERE x.station = c.station AND x.t = d.t - 365)")
    clim = base.format(m="climatology", yhat="(SELECT AVG(x.y) FROM dense x WHERE x.station = c.station AND month(x.t) = month(d.t) AND year(x.t) < year(d.t))")
    return f"""{INTERPOLATED}, {_cut_sql('dense', h, 45)}, sd AS (SELECT c.station, c.cutoff, STDDEV_SAMP(d.y) AS sd FROM cuts c JOIN dense d ON d.station = c.station AND d.t <= c.cutoff GROUP BY 1, 2),
cv AS (SELECT *, date_diff('day', cutoff, ds) AS horizon, yhat - {Z80!r}::DOUBLE * sd AS lo, yhat + {Z80!r}::DOUBLE * sd AS hi
  FROM ({last} UNION ALL {season} UNION ALL {clim}) WHERE yhat IS NOT NULL)"""


_METRIC_SQL = f"""1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(*)) AS r2, sqrt(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(abs(y - yhat)) AS mae,
  100 * AVG(abs((y - yhat) / y)) AS mape_pct, AVG(yhat - y) AS bias, CAST(MAX(ds) - MIN(ds) + 1 AS INTEGER) AS length_days, VAR_SAMP(y) AS variance, COUNT(*) AS n"""
_METRICS = ["r2", "rmse", "mae", "mape_pct", "bias", "variance"]


@query("naive_backtest_metrics", f"""WITH {_naive_sql(14)}, f AS (SELECT station, model, cutoff, {_METRIC_SQL} FROM cv GROUP BY 1, 2, 3)
SELECT station, model, cutoff, length_days, n, {', '.join(f"{q6(c, 3)} AS {c}" for c in _METRICS)} FROM f""")
def naive_backtest_metrics(spark, sf_dir):
    _, cv = naive_cv(spark, sf_dir)
    out = metrics.regression_metrics(cv, ["station", "model", "cutoff"])
    return out.withColumns({c: r6(c, 3) for c in _METRICS})


@query("fold_summary", f"""WITH {_naive_sql(14)}, f AS (SELECT station, model, cutoff, {_METRIC_SQL} FROM cv GROUP BY 1, 2, 3)
SELECT station, model, COUNT(*) AS n_folds, {', '.join(f"{q6(f'AVG({c})', 3)} AS {c}_mean, {q6(f'STDDEV_SAMP({c})', 3)} AS {c}_std" for c in ('rmse', 'mae', 'bias'))} FROM f GROUP BY 1, 2""")
def fold_summary(spark, sf_dir):
    _, cv = naive_cv(spark, sf_dir)
    per_fold = metrics.regression_metrics(cv, ["station", "model", "cutoff"])
    out = metrics.fold_summary(per_fold, ["station", "model"], ["rmse", "mae", "bias"])
    return out.select("station", "model", "n_folds", *[r6(c, 3).alias(c) for c in out.columns[3:]])


# smoothing stated as the published loop: shortest trailing set of horizons with at least k rows
_HORIZON = """hz AS (SELECT station, model, horizon, COUNT(*) AS m, SUM((y - yhat) * (y - yhat)) AS se, SUM(abs(y - yhat)) AS ae, SUM(abs((y - yhat) / y)) AS ape,
  CAST(SUM(CASE WHEN y >= lo AND y <= hi THEN 1 ELSE 0 END) AS DOUBLE) AS ins FROM cv GROUP BY 1, 2, 3),
kk AS (SELECT station, model, greatest(CAST(floor(SUM(m) * 0.1) AS BIGINT), 1) AS k FROM hz GROUP BY 1, 2),
sets AS (SELECT a.station, a.model, a.horizon, b.horizon AS from_h, kk.k, SUM(c.m) AS m, SUM(c.se) AS se, SUM(c.ae) AS ae, SUM(c.ape) AS ape, SUM(c.ins) AS ins
  FROM hz a JOIN hz b ON b.station = a.station AND b.model = a.model AND b.horizon <= a.horizon
  JOIN hz c ON c.station = a.station AND c.model = a.model AND c.horizon BETWEEN b.horizon AND a.horizon
  JOIN kk ON kk.station = a.station AND kk.model = a.model GROUP BY 1, 2, 3, 4, 5),
pick AS (SELECT * FROM sets WHERE m >= k QUALIFY ROW_NUMBER() OVER (PARTITION BY station, model, horizon ORDER BY from_h DESC) = 1),
hm AS (SELECT p.station, p.model, CAST(p.horizon AS INTEGER) AS horizon, sqrt((p.se - (p.m - p.k) * f.se / f.m) / p.k) AS rmse, (p.ae - (p.m - p.k) * f.ae / f.m) / p.k AS mae,
  (p.ape - (p.m - p.k) * f.ape / f.m) / p.k AS mape, (p.ins - (p.m - p.k) * f.ins / f.m) / p.k AS coverage
  FROM pick p JOIN hz f ON f.station = p.station AND f.model = p.model AND f.horizon = p.from_h)"""


@query("horizon_metrics", f"""WITH {_naive_sql(14)}, {_HORIZON} SELECT station, model, horizon, {', '.join(f"{q6(c, 3)} AS {c}" for c in ('rmse', 'mae', 'mape', 'coverage'))} FROM hm""")
def horizon_metrics(spark, sf_dir):
    _, cv = naive_cv(spark, sf_dir)
    out = metrics.horizon_metrics(cv, ["station", "model"])
    return out.withColumns({c: r6(c, 3) for c in ("rmse", "mae", "mape", "coverage")})


_SUMMARY = f"""{_HORIZON}, sdy AS (SELECT station, STDDEV_SAMP(y) AS std_y FROM dense GROUP BY 1),
su AS (SELECT h.station, h.model, AVG(h.rmse) AS rmse, AVG(h.mae) AS mae, AVG(h.mape) AS mape, arg_max(h.rmse, h.horizon) / arg_min(h.rmse, h.horizon) AS horizon_degradation FROM hm h GROUP BY 1, 2),
po AS (SELECT station, model, 1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(*)) AS r2, AVG(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END) AS coverage, COUNT(*) AS n FROM cv GROUP BY 1, 2),
sm AS (SELECT su.*, po.r2, po.coverage, po.n, sdy.std_y, su.rmse / sdy.std_y AS rmse_std_ratio, su.rmse / su.mae AS rmse_mae
  FROM su JOIN po ON po.station = su.station AND po.model = su.model JOIN sdy ON sdy.station = su.station)"""
_SUMMARY_COLUMNS = ["rmse", "mae", "mape", "r2", "coverage", "std_y", "rmse_std_ratio", "rmse_mae", "horizon_degradation"]


def _summary(spark, sf_dir, h=14):
    dense, cv = naive_cv(spark, sf_dir, h)
    spread = dense.groupBy("station").agg(F.stddev_samp("y").alias("std_y"))
    return metrics.cv_summary(cv, spread, ["station", "model"], K, target_coverage=0.8)


@query("cv_summary", f"""WITH {_naive_sql(14)}, {_SUMMARY} SELECT station, model, n, {', '.join(f"{q6(c, 3)} AS {c}" for c in _SUMMARY_COLUMNS)},
  CASE WHEN rmse_std_ratio < 0.5 THEN 'strong' WHEN rmse_std_ratio < 0.8 THEN 'useful' WHEN rmse_std_ratio < 1 THEN 'weak' ELSE 'no better than the mean' END AS skill,
  CASE WHEN rmse_mae < 1.3 THEN 'errors uniform' WHEN rmse_mae < 1.8 THEN 'some large misses' ELSE 'dominated by big blow-ups' END AS blowups,
  CASE WHEN abs(coverage - 0.8) < 0.07 THEN 'well calibrated' WHEN coverage < 0.8 THEN 'overconfident' ELSE 'too vague' END AS calibration FROM sm""")
def cv_summary(spark, sf_dir):
    return _summary(spark, sf_dir).withColumns({c: r6(c, 3) for c in _SUMMARY_COLUMNS})


_SCORE = "rmse * (1 + 0.4 * greatest(horizon_degradation - 1, 0)) * (1 + 0.3 * greatest(rmse_mae - 1, 0))"


@query("select_score_ranking", f"""WITH {_naive_sql(14)}, {_SUMMARY} SELECT station, model, {q6(_SCORE, 2)} AS select_score,
  CAST(ROW_NUMBER() OVER (PARTITION BY station ORDER BY {_SCORE}, model) AS INTEGER) AS place FROM sm QUALIFY place <= 2""")
def select_score_ranking(spark, sf_dir):
    scored = metrics.select_score(_summary(spark, sf_dir), schemas.LAMBDA_DEGRADATION, schemas.LAMBDA_SPREAD)
    top = metrics.top_configs(scored, K, 2, "model")
    return top.select("station", "model", r6("select_score", 2).alias("select_score"), "place")


@query("coverage_by_horizon", f"""WITH {_naive_sql(30)} SELECT station, model, CAST(horizon AS INTEGER) AS horizon, {q6('AVG(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END)')} AS coverage FROM cv GROUP BY 1, 2, 3""")
def coverage_by_horizon(spark, sf_dir):
    _, cv = naive_cv(spark, sf_dir, 30)
    out = metrics.coverage(cv, ["station", "model", "horizon"])
    return out.withColumn("coverage", r6("coverage"))


@query("error_cloud", f"""WITH {_naive_sql(14)} SELECT station, model, cutoff, ds, CAST(horizon AS INTEGER) AS horizon, {q6('yhat - y', 3)} AS error FROM cv""")
def error_cloud(spark, sf_dir):
    _, cv = naive_cv(spark, sf_dir)
    return metrics.error_by_horizon(cv, ["station", "model"]).withColumn("error", r6("error", 3))


_OLS = f"""WITH {MERGED}, fr AS (SELECT m.station, m.t AS ds, m.level AS y, w.soil_temp AS x FROM merged m JOIN merged w ON w.station = m.station AND w.t = m.t - 14 WHERE m.level IS NOT NULL),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station ORDER BY ds) AS pos, COUNT(*) OVER (PARTITION BY station) AS n FROM fr),
te AS (SELECT *, date_trunc('month', ds) AS mo, MIN(ds) OVER (PARTITION BY station, date_trunc('month', ds)) AS fs FROM p WHERE pos > floor(n * 0.8)),
fit AS (SELECT f.station, f.fs, regr_slope(r.y, r.x) AS slope, regr_intercept(r.y, r.x) AS intercept, COUNT(*) AS n_train FROM (SELECT DISTINCT station, fs FROM te) f
  JOIN fr r ON r.station = f.station AND r.ds < f.fs GROUP BY 1, 2),
cv AS (SELECT te.station, te.fs AS test_start, te.ds, te.y, fit.n_train, fit.intercept + fit.slope * te.x AS yhat FROM te JOIN fit ON fit.station = te.station AND fit.fs = te.fs)"""


@query("ols_lagged_backtest", f"""{_OLS}, f AS (SELECT station, test_start, {_METRIC_SQL} FROM cv GROUP BY 1, 2)
SELECT station, test_start, n, length_days, {', '.join(f"{q6(c, 2)} AS {c}" for c in ('rmse', 'mae', 'mape_pct', 'bias'))} FROM f""")
def ols_lagged_backtest(spark, sf_dir):
    frame = reuse(frames.train_frame(panels.merged(spark, sf_dir), K, "t", "level", ["soil_temp"], 14))
    plan = folds.monthly_folds(frame, K, "ds", 0.8)
    cutoffs = plan.select("station", F.date_sub("test_start", 1).alias("cutoff"))
    lines = models.expanding_line(frame, cutoffs, K, "soil_temp_lag14", "y")
    tested = frame.withColumn("month", F.trunc("ds", "MM")).join(plan, [*K, "month"]).where("ds >= test_start")
    tested = tested.withColumn("cutoff", F.date_sub("test_start", 1)).join(lines, [*K, "cutoff"])
    tested = tested.withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("soil_temp_lag14"))
    out = metrics.regression_metrics(tested, ["station", "test_start"])
    return out.select("station", "test_start", "n", "length_days", *[r6(c, 2).alias(c) for c in ("rmse", "mae", "mape_pct", "bias")])


# two features in closed form: centred sums of squares and products
_LEADS = f"""{_WIDE}, ld AS (SELECT a.station, a.month, k.i AS lead, a.SPI AS x1, a.SSTI AS x2, b.SPLI AS y, ROW_NUMBER() OVER (PARTITION BY a.station, k.i ORDER BY a.month DESC) AS back
  FROM pw a CROSS JOIN (SELECT CAST(UNNEST([1, 2, 3]) AS INTEGER) AS i) k LEFT JOIN pw b ON b.station = a.station AND b.month = CAST(a.month + INTERVAL 1 MONTH * k.i AS DATE)),
tr AS (SELECT * FROM ld WHERE back > 10 AND x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL),
sf AS (SELECT station, lead, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my, VAR_POP(x1) AS s11, VAR_POP(x2) AS s22, COVAR_POP(x1, x2) AS s12, COVAR_POP(x1, y) AS s1y, COVAR_POP(x2, y) AS s2y, COUNT(*) AS n FROM tr GROUP BY 1, 2),
co AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM sf)"""


@query("linear_multi", f"""WITH {_LEADS} SELECT ld.station, ld.month, ld.lead, co.n AS n_train, {q6('ld.y')} AS y,
  {q6('co.my + co.b1 * (ld.x1 - co.m1) + co.b2 * (ld.x2 - co.m2)')} AS yhat FROM ld JOIN co ON co.station = ld.station AND co.lead = ld.lead WHERE back BETWEEN 5 AND 7""")
def linear_multi(spark, sf_dir):
    wide = pivot_panel(panel_of(spark, sf_dir, (1,)), K, ["SPLI", "SPI", "SSTI"], scale=1)
    tagged = frames.lead_frame(wide, K, "month", "SPLI", [1, 2, 3])
    leads = [F.struct(F.lit(i).alias("lead"), F.col(f"SPLI_{i}m").alias("y")) for i in (1, 2, 3)]
    long = reuse(tagged.select("station", "month", "split", "SPI", "SSTI", F.inline(F.array(*leads))))
    by = ["station", "lead"]
    fitted = models.fit_linear(long.where("split = 'train'"), by, ["SPI", "SSTI"], "y")
    out = models.predict_linear(long.where("split = 'test'"), fitted, by, ["SPI", "SSTI"])
    return out.select(*by, "month", "n_train", r6("y").alias("y"), r6("yhat").alias("yhat"))


# least squares by taking each column in turn out of all later ones, sums over training rows only
_X = [n for n in NAMES if n != "SPLI"]


def _residual_sql(columns: list[str], y: str) -> str:
    """CTEs from ``g0`` (station, lead, split, columns, y) to ``gs``, where ``y`` is the residual of a fit on all columns."""
    text, names = [], ["one_", *columns]
    for k, c in enumerate(names):
        rest = [*names[k + 1:], y]
        w = "OVER (PARTITION BY station, lead)"
        ss = f"SUM({c} * {c}) FILTER (split = 'train') {w}"
        taken = ", ".join(f"{j} - CASE WHEN {ss} > 1e-9 THEN SUM({j} * {c}) FILTER (split = 'train') {w} / ({ss}) ELSE 0 END * {c} AS {j}" for j in rest)
        text.append(f"g{k + 1} AS (SELECT * REPLACE ({taken}) FROM g{k})")
    return ",\n".join(text) + f", gs AS (SELECT * FROM g{len(names)})"


_LEAD_ROWS = f"""{PANEL_SQL}, pn AS (SELECT station, month, {', '.join(f"MAX(CASE WHEN index_name = '{n}' THEN z END) AS {n}" for n in NAMES)} FROM panel WHERE scale = 1 GROUP BY 1, 2),
ld AS (SELECT a.station, a.month, k.i AS lead, {', '.join(f'a.{c}' for c in _X)}, b.SPLI AS target, ROW_NUMBER() OVER (PARTITION BY a.station, k.i ORDER BY a.month DESC) AS back
  FROM pn a CROSS JOIN (SELECT CAST(UNNEST([1, 2, 3]) AS INTEGER) AS i) k LEFT JOIN pn b ON b.station = a.station AND b.month = CAST(a.month + INTERVAL 1 MONTH * k.i AS DATE)),
g0 AS (SELECT *, target AS e, 1::DOUBLE AS one_, CASE WHEN back > 10 THEN 'train' ELSE 'test' END AS split FROM ld
  WHERE (back > 10 OR back BETWEEN 5 AND 7) AND target IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _X)}),
{_residual_sql(_X, 'e')}"""


@query("linear_multi_metrics", f"""WITH {_LEAD_ROWS} SELECT station, lead, COUNT(*) FILTER (split = 'train') AS n_train, COUNT(*) FILTER (split = 'test') AS n_test,
  {q6("1 - SUM(e * e) FILTER (split = 'train') / NULLIF(VAR_POP(target) FILTER (split = 'train') * COUNT(*) FILTER (split = 'train'), 0)")} AS r2_train,
  {q6("1 - SUM(e * e) FILTER (split = 'test') / NULLIF(VAR_POP(target) FILTER (split = 'test') * COUNT(*) FILTER (split = 'test'), 0)", 4)} AS r2_test,
  {q6("sqrt(AVG(e * e) FILTER (split = 'test'))")} AS rmse, {q6("AVG(abs(e)) FILTER (split = 'test')")} AS mae FROM gs GROUP BY 1, 2""")
def linear_multi_metrics(spark, sf_dir):
    """Level index one, two and three months ahead from all nine other indices."""
    wide = pivot_panel(panel_of(spark, sf_dir, (1,)), K, NAMES, scale=1)
    tagged = reuse(frames.lead_frame(wide, K, "month", "SPLI", [1, 2, 3]))
    targets = [f"SPLI_{i}m" for i in (1, 2, 3)]
    fitted = models.fit_linear(tagged.where("split = 'train'"), K, _X, targets)
    rows = models.predict_linear(tagged.dropna(subset=_X), fitted, K, _X)
    rows = rows.withColumns({"lead": F.substring("target", 6, 1).cast("int"), "y": F.coalesce(*[F.when(F.col("target") == c, F.col(c)) for c in targets])})
    return metrics.split_metrics(rows.where("y IS NOT NULL"), ["station", "lead"]).select(
        "station", "lead", "n_train", "n_test", r6("r2_train").alias("r2_train"), r6("r2_test", 4).alias("r2_test"), r6("rmse").alias("rmse"), r6("mae").alias("mae"))


@query("seasonal_naive_forecast", f"""WITH {SPLI}, start_ AS (SELECT station, month AS t, z AS y, CAST((ROW_NUMBER() OVER (PARTITION BY station ORDER BY month) - 1) % 12 AS INTEGER) AS pos,
  CAST(0 AS DOUBLE) AS seasonal, CAST(1 AS DOUBLE) AS weight FROM spli WHERE z IS NOT NULL), {_robust_pass('start_', 'pass1', 12)}, {_robust_pass('pass1', 'pass2', 12)},
l AS (SELECT station, MAX(t) AS last_train, arg_max(trend, t) AS trend_last FROM pass2 GROUP BY 1),
a AS (SELECT l.*, CAST(UNNEST([1, 2, 3]) AS INTEGER) AS step FROM l), b AS (SELECT *, CAST(last_train + INTERVAL 1 MONTH * step AS DATE) AS ds FROM a)
SELECT b.station, b.step, b.ds, {q6('b.trend_last + (SELECT arg_max(p.seasonal, p.t) FROM pass2 p WHERE p.station = b.station AND month(p.t) = month(b.ds))')} AS yhat FROM b""")
def seasonal_naive_forecast(spark, sf_dir):
    monthly = level_index(spark, sf_dir).select("station", "month", "z")
    parts = reuse(decompose_robust(monthly, K, "month", "z", 12))
    return smoothing.seasonal_naive(parts, K, "month", [1, 2, 3]).withColumn("yhat", r6("yhat"))


@query("ar_diff_forecast", f"""WITH {robust_sql(365)}, fl AS (SELECT station, t, pos, y - seasonal AS a, LAG(y - seasonal) OVER w AS a1, LAG(y - seasonal, 2) OVER w AS a2 FROM pass2 WINDOW w AS (PARTITION BY station ORDER BY t)),
ph AS (SELECT station, SUM((a - a1) * (a1 - a2)) / SUM((a1 - a2) * (a1 - a2)) AS phi FROM fl WHERE a2 IS NOT NULL GROUP BY 1),
la AS (SELECT station, MAX(t) AS last_train, arg_max(a, t) AS a, arg_max(a - a1, t) AS d, arg_max(pos, t) AS pos FROM fl GROUP BY 1),
st AS (SELECT la.*, ph.phi, CAST(UNNEST(range(1, 91)) AS INTEGER) AS step FROM la JOIN ph ON ph.station = la.station)
SELECT st.station, {q6('st.phi')} AS phi, st.step, CAST(st.last_train + st.step AS DATE) AS ds,
  {q6('st.a + st.d * list_sum(list_transform(range(1, st.step + 1), lambda k: pow(st.phi, k))) + (SELECT MAX(p.seasonal) FROM pass2 p WHERE p.station = st.station AND p.pos = (st.pos + st.step) % 365)', 3)} AS yhat FROM st""")
def ar_diff_forecast(spark, sf_dir):
    parts = reuse(decompose_robust(dense_levels(spark, sf_dir), K, "t", "level", 365))
    out = smoothing.ar_diff_forecast(parts, K, "t", 90, 365)
    return out.withColumns({"phi": r6("phi"), "yhat": r6("yhat", 3)})


_HW_GRID = {"alpha": [0.2, 0.5, 0.9], "beta": [0.01, 0.2], "gamma": [0.01, 0.2], "phi": [0.9, 0.98]}


def _holt_winters_sql(period: int, horizon: int) -> str:
    """The recursion day by day, one row per station and grid point; a row replaces its predecessor."""
    grid = ", ".join(f"(SELECT UNNEST({v!r})::DOUBLE AS {k})" for k, v in _HW_GRID.items())
    level = "alpha * (d.y - s[1]) + (1 - alpha) * (l + phi * b)"
    keys = "station, alpha, beta, gamma, phi"
    return f"""WITH RECURSIVE {INTERPOLATED}, num AS (SELECT station, t, y, ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) AS k FROM dense WHERE y IS NOT NULL),
base AS (SELECT station, COUNT(*) AS n, MAX(t) AS last_train, AVG(y) FILTER (k <= {period}) AS m1, AVG(y) FILTER (k > {period} AND k <= 2 * {period}) AS m2,
  list(y ORDER BY k) FILTER (k <= {period}) AS y1 FROM num GROUP BY 1),
rec({keys}, k, l, b, s, sse) USING KEY ({keys}) AS (
  SELECT {keys}, {period}::BIGINT, m1, (m2 - m1) / {period}, list_transform(y1, lambda x: x - m1), 0::DOUBLE FROM base, {grid} WHERE n >= 2 * {period}
  UNION
  SELECT r.station, alpha, beta, gamma, phi, r.k + 1, {level}, beta * (({level}) - l) + (1 - beta) * (phi * b),
    list_append(s[2:], gamma * (d.y - l - phi * b) + (1 - gamma) * s[1]), sse + pow(d.y - (l + phi * b + s[1]), 2)
  FROM rec r JOIN num d ON d.station = r.station AND d.k = r.k + 1),
best AS (SELECT rec.*, base.n, base.last_train FROM rec JOIN base USING (station)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY station ORDER BY sse, alpha, beta, gamma, phi) = 1)
SELECT station, alpha, beta, gamma, phi, {q6(f'sqrt(sse / (n - {period}))', 3)} AS fit_rmse, CAST(h AS INTEGER) AS step, CAST(last_train + CAST(h AS INTEGER) AS DATE) AS ds,
  {q6(f'l + phi * (1 - pow(phi, h)) / (1 - phi) * b + s[(h - 1) % {period} + 1]', 3)} AS yhat, CAST(NULL AS VARCHAR) AS reason
FROM best, (SELECT range AS h FROM range(1, {horizon} + 1))
UNION ALL SELECT station, NULL, NULL, NULL, NULL, NULL, CAST(h AS INTEGER), CAST(last_train + CAST(h AS INTEGER) AS DATE), NULL, n || ' values, two cycles have {2 * period}'
FROM base, (SELECT range AS h FROM range(1, {horizon} + 1)) WHERE n < 2 * {period}"""


@query("holt_winters_grid", _holt_winters_sql(365, 90))
def holt_winters_grid(spark, sf_dir):
    out = smoothing.holt_winters_grid(
        dense_levels(spark, sf_dir), K, "t", "level", 365, 90,
        alphas=_HW_GRID["alpha"], betas=_HW_GRID["beta"], gammas=_HW_GRID["gamma"], phis=_HW_GRID["phi"],
    )
    return out.withColumns({c: r6(c, 3) for c in ("fit_rmse", "yhat")})


_LAGGED = [f"{c}_lag14" for c in REGRESSORS]
_OK = " AND ".join(f"{c} IS NOT NULL" for c in _LAGGED)
_HEALTH = f"""{DAILY}, {calendar('daily', extra=14)}, fr AS (SELECT c.station, c.t, m.level AS y, {', '.join(f'w.{c} AS {c}_lag14' for c in REGRESSORS)},
   ROW_NUMBER() OVER (PARTITION BY c.station ORDER BY c.t DESC) AS back
  FROM cal c LEFT JOIN daily w ON w.station = c.station AND w.t = c.t - 14 LEFT JOIN daily m ON m.station = c.station AND m.t = c.t),
  u AS (SELECT *, y IS NOT NULL AND {_OK} AS ok FROM fr),
  g AS (SELECT station, COUNT(*) FILTER (back <= 14 AND NOT ({_OK})) AS fn, COUNT(*) FILTER (back <= 14 AND y IS NOT NULL) AS fy,
  COUNT(*) FILTER (NOT ok) AS lost, COUNT(*) FILTER (ok) AS n, {' + '.join(f'CASE WHEN abs(corr({a}, {b}) FILTER (ok)) > 0.9 THEN 1 ELSE 0 END' for a, b in combinations(_LAGGED, 2))} AS near,
  {' + '.join(f'CASE WHEN COALESCE(STDDEV_SAMP({c}) FILTER (ok), 0) = 0 THEN 1 ELSE 0 END' for c in _LAGGED)} AS dead, greatest({', '.join(f'abs(corr({c}, y) FILTER (ok))' for c in _LAGGED)}) AS best FROM u GROUP BY 1)"""


@query("series_health", f"""WITH {_HEALTH}, c AS (
  SELECT station, 'duplicate_days' AS "check", 0::DOUBLE AS value, true AS ok FROM g UNION ALL SELECT station, 'max_gap_days', 1, true FROM g
  UNION ALL SELECT station, 'lag_error', 0, true FROM g UNION ALL SELECT station, 'future_null_regressors', fn, fn = 0 FROM g
  UNION ALL SELECT station, 'future_targets', fy, fy = 0 FROM g UNION ALL SELECT station, 'rows_lost', lost, n > 0 FROM g
  UNION ALL SELECT station, 'rows_per_regressor', n / 6, n / 6 >= 10 FROM g UNION ALL SELECT station, 'constant_regressors', dead, dead = 0 FROM g
  UNION ALL SELECT station, 'collinear_pairs', near, near = 0 FROM g UNION ALL SELECT station, 'best_target_r', best, best > 0 FROM g)
SELECT station, "check", {q6('value')} AS value, ok FROM c""")
def series_health(spark, sf_dir):
    """The checks over all six regressors."""
    frame = extend_and_lag(model_daily(spark, sf_dir), K, "t", REGRESSORS, 14)
    out = quality.series_health(frame, K, "t", "level", _LAGGED, dict(zip(_LAGGED, REGRESSORS)), 14)
    return out.withColumn("value", r6("value"))


# --- learned models ----------------------------------------------------------------------

def _additive(spark, sf_dir, h, configs):
    frame = reuse(frames.train_frame(model_daily(spark, sf_dir), K, "t", "level", REGRESSORS, h))
    cutoffs = folds.rolling_cutoffs(frame, K, "ds", h, schemas.CV_PERIOD_DAYS)
    return models.backtest_additive(frame, cutoffs, K, frames.lag_names(REGRESSORS, h), configs, h)


RETAINED = {"changepoint_prior_scale": 0.3, "seasonality_prior_scale": 0.1, "changepoint_range": 0.8}
TREND_ONLY = {"changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0, "changepoint_range": 0.8}
_CV_COLUMNS = f"config_id, station, cutoff, ds, horizon, {', '.join(f'{q6(c, 2)} AS {n}' for c, n in (('y', 'y'), ('yhat', 'yhat'), ('lo', 'yhat_lower'), ('hi', 'yhat_upper')))}"


def _rounded_cv(cv):
    return cv.withColumns({c: r6(c, 2) for c in ("y", "yhat", "yhat_lower", "yhat_upper")})


@query("additive_backtest", f"""WITH RECURSIVE {DAILY}, {lagged_sql(14, out='all_')}, fr AS (SELECT * FROM all_ WHERE y IS NOT NULL), {_cut_sql('fr', 14, 45, ds='ds')},
{additive_sql('fr', 'cuts', REGRESSORS, [RETAINED], '14')} SELECT {_CV_COLUMNS} FROM cvi""")
def additive_backtest(spark, sf_dir):
    """Retained configuration: changepoint 0.3, seasonality 0.1, range 0.8."""
    return _rounded_cv(_additive(spark, sf_dir, 14, [RETAINED]))


@query("univariate_additive_backtest", f"""WITH RECURSIVE {INTERPOLATED}, fr AS (SELECT station, t AS ds, y FROM dense), {_cut_sql('fr', 14, 45, ds='ds')},
{additive_sql('fr', 'cuts', [], [TREND_ONLY], '14')} SELECT {_CV_COLUMNS} FROM cvi""")
def univariate_additive_backtest(spark, sf_dir):
    """Trend and season only."""
    rows = reuse(dense_levels(spark, sf_dir).select("station", F.col("t").alias("ds"), F.col("level").alias("y")))
    cutoffs = folds.rolling_cutoffs(rows, K, "ds", 14, schemas.CV_PERIOD_DAYS)
    return _rounded_cv(models.backtest_additive(rows, cutoffs, K, [], [TREND_ONLY], 14))


def _sweep_sql(horizons: tuple[int, ...]) -> str:
    """CTEs up to ``sm``, the summary of every (station|horizon, configuration)."""
    columns = ", ".join(["ds", "y", *REGRESSORS])
    frames_ = ",\n".join(lagged_sql(h, out=f"f{h}") for h in horizons)
    union = " UNION ALL ".join(f"SELECT station || '|{h}' AS station, {columns} FROM f{h} WHERE y IS NOT NULL" for h in horizons)
    parts = ", ".join(f"fr{h} AS (SELECT * FROM fr WHERE station LIKE '%|{h}'), {_cut_sql(f'fr{h}', h, 45, f'cuts{h}', 'ds')}" for h in horizons)
    cuts = " UNION ALL ".join(f"SELECT * FROM cuts{h}" for h in horizons)
    return f"""{DAILY}, {frames_}, fr AS MATERIALIZED ({union}), {parts}, cuts AS ({cuts}),
{additive_sql('fr', 'cuts', REGRESSORS, tuning.grid_configs(), "CAST(split_part(c.station, '|', 2) AS INTEGER)", prefix='a_')},
cv AS (SELECT *, config_id AS model FROM a_cvi), dense AS (SELECT station, y FROM fr), {_SUMMARY},
tuned AS (SELECT split_part(station, '|', 1) AS station, CAST(split_part(station, '|', 2) AS INTEGER) AS horizon, model AS config_id, g.cps AS changepoint_prior_scale,
  g.sps AS seasonality_prior_scale, g.share AS changepoint_range, sm.* EXCLUDE (station, model), {_SCORE} AS select_score FROM sm JOIN a_grid g ON g.config_id = sm.model),
best AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY station, horizon ORDER BY select_score, config_id) AS INTEGER) AS place FROM tuned)"""


_TUNED = ["rmse", "mae", "mape", "r2", "coverage", "std_y", "rmse_std_ratio", "rmse_mae", "horizon_degradation", "select_score"]
_TUNED_SQL = f"""station, horizon, config_id, changepoint_prior_scale, seasonality_prior_scale, changepoint_range, n, {', '.join(f"{q6(c, 3)} AS {c}" for c in _TUNED)}"""


def _sweep(spark, sf_dir):
    return tuning.tune(reuse(model_daily(spark, sf_dir)), K, "t", "level", REGRESSORS, schemas.HORIZONS)


def _tuned(results, *more):
    return results.select("station", "horizon", "config_id", "changepoint_prior_scale", "seasonality_prior_scale", "changepoint_range", "n",
                          *[r6(c, 3).alias(c) for c in _TUNED], *more)


@query("grid_select_score", f"WITH RECURSIVE {_sweep_sql(schemas.HORIZONS)} SELECT {_TUNED_SQL}, CAST(NULL AS VARCHAR) AS error, place FROM best")
def grid_select_score(spark, sf_dir):
    """The full sweep for both horizons: every station, horizon and configuration with its metrics and place."""
    results = _sweep(spark, sf_dir)
    return _tuned(metrics.top_configs(results, ["station", "horizon"], len(tuning.grid_configs())), "error", "place")


# the winner refitted on all rows, its days ahead beside the observed ones, the index of their months
_REFIT = f"""{_sweep_sql((30,))}, ends_ AS (SELECT station, MAX(ds) AS cutoff FROM f30 WHERE y IS NOT NULL GROUP BY 1),
{additive_sql('f30', 'ends_', REGRESSORS, tuning.grid_configs(), '30', prefix='b_')},
won AS (SELECT s.* FROM b_scored s JOIN best b ON b.station = s.station AND b.config_id = s.config_id AND b.place = 1),
both_ AS (SELECT station, t, level, 0 AS fc FROM daily WHERE level IS NOT NULL UNION ALL SELECT station, ds, yhat, 1 FROM won WHERE ds > cutoff), {FORECAST_POOL}, {ppf_sql('pooled', 'indexed')}"""


@query("refit_forecast_index", f"""WITH RECURSIVE {_REFIT}, lim(b, incl, label) AS (VALUES {SEVERITY_LIMITS})
SELECT s.station, s.month, {q6('s.z')} AS spli, {q6('s.mean_level', 2)} AS mean_level, obs_days, fc_days, CAST(day(last_day(s.month)) AS INTEGER) AS days_in_month,
  CASE WHEN obs_days > 0 THEN 'blended' ELSE 'forecast-only' END AS mode, (SELECT arg_min(label, b) FROM lim WHERE s.z < b OR (incl AND s.z = b)) AS label FROM indexed s""")
def refit_forecast_index(spark, sf_dir):
    """Sweep, refit of the winner, forecast and index of the forecast for 30 days."""
    from wellspan.plans.reports import forecast_job
    daily = reuse(model_daily(spark, sf_dir))
    out = forecast_job(daily, K, "t", "level", REGRESSORS, 30)["index"]
    return out.withColumns({"spli": r6("spli"), "mean_level": r6("mean_level", 2)})


# --- forecasts of the retained configuration ----------------------------------------------

_SCORED_SQL = f"""{DAILY}, {lagged_sql(14, out='f14')}, fr AS (SELECT * FROM f14 WHERE y IS NOT NULL), {_cut_sql('fr', 14, 45, ds='ds')},
{additive_sql('fr', 'cuts', REGRESSORS, [RETAINED], '14', prefix='a_')}, ends_ AS (SELECT station, MAX(ds) AS cutoff FROM fr GROUP BY 1),
{additive_sql('f14', 'ends_', REGRESSORS, [RETAINED], '14', prefix='b_')},
q AS (SELECT station, horizon, quantile_cont(y - yhat, 0.1) AS low, quantile_cont(y - yhat, 0.9) AS high, COUNT(*) AS n_errors FROM a_cv GROUP BY 1, 2),
forecast AS (SELECT s.*, greatest(CAST(s.ds - s.cutoff AS INTEGER), 0) AS horizon, q.n_errors, s.yhat + COALESCE(q.low, -{Z80!r}::DOUBLE * s.sigma) AS lo, s.yhat + COALESCE(q.high, {Z80!r}::DOUBLE * s.sigma) AS hi
  FROM b_scored s LEFT JOIN q ON q.station = s.station AND q.horizon = s.ds - s.cutoff)"""


def _scored_forecast(spark, sf_dir):
    """The retained configuration fitted on all rows: history, 14 days ahead, intervals from its backtest."""
    regs = frames.lag_names(REGRESSORS, 14)
    frame = reuse(frames.future_frame(model_daily(spark, sf_dir), K, "t", "level", REGRESSORS, 14))
    known = frame.where(F.col("y").isNotNull())
    cutoffs = folds.rolling_cutoffs(known, K, "ds", 14, schemas.CV_PERIOD_DAYS)
    errors = models.error_quantiles(models.backtest_additive(known, cutoffs, K, regs, [RETAINED], 14), K)
    last = known.groupBy(*K).agg(F.max("ds").alias("cutoff"))
    fitted = models.fit_additive(frame, last, K, regs, [RETAINED])
    return models.with_tested_interval(models.predictions(frame, fitted, K, regs), errors, K)


@query("scored_forecast", f"""WITH RECURSIVE {_SCORED_SQL} SELECT station, ds, config_id, cutoff, n AS n_train, horizon, n_errors, {q6('y', 2)} AS y, {q6('yhat', 2)} AS yhat,
  {q6('lo', 2)} AS yhat_lower, {q6('hi', 2)} AS yhat_upper, CASE WHEN n_errors IS NULL THEN 'fit' ELSE 'backtest' END AS interval_from FROM forecast""")
def scored_forecast(spark, sf_dir):
    return _rounded_cv(_scored_forecast(spark, sf_dir))


@query("forecast_interval_coverage", f"""WITH RECURSIVE {_SCORED_SQL.replace('0.1)', '0.125)').replace('0.9)', '0.875)')} SELECT a.station, a.horizon, COUNT(*) AS n, {q6('AVG(CASE WHEN a.y >= a.yhat + q.low AND a.y <= a.yhat + q.high THEN 1.0 ELSE 0.0 END)')} AS coverage,
  AVG(CASE WHEN a.y >= a.yhat + q.low AND a.y <= a.yhat + q.high THEN 1.0 ELSE 0.0 END) BETWEEN 0.5 AND 1 AS within_bounds FROM a_cv a JOIN q ON q.station = a.station AND q.horizon = a.horizon GROUP BY 1, 2""")
def forecast_interval_coverage(spark, sf_dir):
    """Share of backtest days inside the interval of 0.75 that their errors give, by days ahead."""
    frame = reuse(frames.train_frame(model_daily(spark, sf_dir), K, "t", "level", REGRESSORS, 14))
    cutoffs = folds.rolling_cutoffs(frame, K, "ds", 14, schemas.CV_PERIOD_DAYS)
    cv = reuse(models.backtest_additive(frame, cutoffs, K, frames.lag_names(REGRESSORS, 14), [RETAINED], 14))
    bounds = models.error_quantiles(cv, K, 0.75).drop("n_errors")
    rows = cv.drop("yhat_lower", "yhat_upper").join(bounds, [*K, "horizon"])
    rows = rows.withColumns({"yhat_lower": F.col("yhat") + F.col("low"), "yhat_upper": F.col("yhat") + F.col("high")})
    out = metrics.coverage(rows, [*K, "horizon"]).join(rows.groupBy(*K, "horizon").agg(F.count(F.lit(1)).alias("n")), [*K, "horizon"])
    return out.withColumns({"within_bounds": F.col("coverage").between(0.5, 1), "coverage": r6("coverage")})


@query("gbt_backtest")
def gbt_backtest(spark, sf_dir):
    """Boosted trees on the 30-row holdout, metrics for both parts."""
    daily = frames.holdout(model_daily(spark, sf_dir), K, "t", ["level", *REGRESSORS], 30)
    out = models.gbt_backtest(reuse(daily), K, "t", REGRESSORS, "level")
    return metrics.regression_metrics(out, ["station", "split"])


_GBT_ROWS = f"SELECT station, t, level AS y, {', '.join(REGRESSORS)} FROM daily WHERE level IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in REGRESSORS)}"


@query("gbt_walk_forward_folds", f"""WITH {DAILY}, done AS ({_GBT_ROWS}), p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) AS pos, COUNT(*) OVER (PARTITION BY station) AS n FROM done),
f AS (SELECT station, CAST(date_trunc('month', t) AS DATE) AS month, MIN(t) AS date_start, MAX(t) AS date_end, COUNT(*) AS n_test, VAR_SAMP(y) AS v FROM p WHERE pos > floor(n * 0.8) GROUP BY 1, 2)
SELECT f.station, f.month, CAST(ROW_NUMBER() OVER (PARTITION BY station ORDER BY month) AS INTEGER) AS fold, date_start, date_end, n_test, {q6('v', 2)} AS variance,
  (SELECT COUNT(*) FROM done d WHERE d.station = f.station AND d.t < f.date_start) AS n_train FROM f""")
def gbt_walk_forward_folds(spark, sf_dir):
    """What each fold of :func:`gbt_walk_forward` trains on and tests, from its tagged rows."""
    rows = model_daily(spark, sf_dir).dropna(subset=["level", *REGRESSORS])
    tagged, plan = models.walk_forward_tags(rows, K, "t")
    tested = tagged.where("fold_month IS NOT NULL").groupBy("station", F.col("fold_month").alias("month")).agg(
        F.min("t").alias("date_start"), F.max("t").alias("date_end"), F.count(F.lit(1)).alias("n_test"), F.var_samp("level").alias("variance"))
    return tested.join(plan.select("station", "month", "fold", "n_train"), ["station", "month"]).withColumn("variance", r6("variance", 2))


@query("gbt_walk_forward")
def gbt_walk_forward(spark, sf_dir):
    """Boosted trees refitted month by month: metrics of each station and fold, and their mean (fold NULL).

    30 rounds at a rate of 0.3; the operator's defaults are 100 at 0.1.
    """
    out = models.gbt_walk_forward(model_daily(spark, sf_dir), K, "t", REGRESSORS, "level", n_estimators=30, learning_rate=0.3)
    per_fold = metrics.split_metrics(out, ["station", "fold_month"]).where("n_test > 0")
    return metrics.with_fold_mean(per_fold, ["station"], "fold_month")


# --- parameters and run log ----------------------------------------------------------------

def _param_map(n):
    return F.create_map(
        F.lit("changepoint_prior_scale"), (n / 10).cast("string"), F.lit("yearly_seasonality"), F.when(n % 2 == 0, F.lit("True")).otherwise(F.lit("false")),
        F.lit("seasonality_mode"), F.lit("additive"), F.lit("unknown_key"), F.lit("x"),
    )


@query("resolve_params", """
SELECT n_name AS model, CASE WHEN n_regionkey <> 2 THEN n_nationkey END AS previous_version, CASE WHEN n_regionkey <> 2 THEN 'production' ELSE 'tuning' END AS params_from,
  CASE WHEN n_regionkey <> 2 THEN n_nationkey ELSE n_nationkey + 100 END / 10.0::DOUBLE AS changepoint_prior_scale, CAST(NULL AS DOUBLE) AS seasonality_prior_scale,
  CAST(NULL AS DOUBLE) AS changepoint_range, CAST(NULL AS DOUBLE) AS interval_width, CAST(NULL AS BOOLEAN) AS weekly_seasonality, CAST(NULL AS BOOLEAN) AS daily_seasonality,
  n_nationkey % 2 = 0 AS yearly_seasonality, 'additive' AS seasonality_mode FROM nation""")
def resolve_params(spark, sf_dir):
    nation = panels.table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    targets = nation.select(F.col("n_name").alias("model"))
    production = nation.where("n_regionkey <> 2").select(F.col("n_name").alias("model"), _param_map(n).alias("params"), n.alias("version"))
    tuned = nation.select(F.col("n_name").alias("model"), _param_map(n + 100).alias("params"))
    return tuning.resolve_params(targets, production, tuned, ["model"])


# the rule: versions go on from the highest one, the highest of a station is in production
_RUNS_SQL = f""", runs AS (
  SELECT station, NULL AS model, NULL AS run_id, NULL AS metric_rmse, NULL AS tag_horizon, version FROM old UNION ALL
  SELECT s.station, s.model, sha256(s.station || '|' || s.model || '|' || CAST(l.last_day AS VARCHAR)), {q6('s.rmse', 3)}, '14',
    COALESCE((SELECT MAX(version) FROM old o WHERE o.station = s.station), 0) + (SELECT COUNT(*) FROM sm b WHERE b.station = s.station AND b.model <= s.model)
  FROM sm s JOIN (SELECT station, MAX(t) AS last_day FROM obs GROUP BY 1) l ON l.station = s.station)
SELECT station, model, run_id, model AS param_model, metric_rmse, tag_horizon, CAST(version AS INTEGER) AS version,
  CAST((SELECT MAX(version) FROM runs b WHERE b.station = a.station AND b.version < a.version) AS INTEGER) AS previous_version,
  NOT EXISTS (SELECT 1 FROM runs b WHERE b.station = a.station AND b.version > a.version) AS is_production FROM runs a"""


@query("model_runs_registered", f"""WITH {_naive_sql(14)}, {_SUMMARY}, old AS (SELECT DISTINCT station, 3 AS version FROM sm WHERE station < '3')
{_RUNS_SQL}""")
def model_runs_registered(spark, sf_dir):
    ends = panels.obs(spark, sf_dir).groupBy("station").agg(F.max("t").alias("last_day"))
    results = reuse(_summary(spark, sf_dir).withColumn("horizon", F.lit(14)).join(ends, "station"))
    runs = tuning.model_runs(results, K, ["model"], ["rmse", "mae"], ["horizon"], trained_to="last_day")
    history = results.where("station < '3'").select("station", F.lit(3).alias("version")).distinct()
    out = tuning.register_runs(history, runs, K, [F.col("params")["model"]])
    return out.select(
        "station", F.col("params")["model"].alias("model"), "run_id", F.col("params")["model"].alias("param_model"),
        r6(F.col("metrics")["rmse"], 3).alias("metric_rmse"), F.col("tags")["horizon"].alias("tag_horizon"),
        "version", "previous_version", "is_production",
    )


_CONFIG_OF = "(ascii(station) + h) % 15"
_VERSIONS_SQL = f"""WITH {DAILY}, {lagged_sql(14, out='f14')}, {lagged_sql(30, out='f30')}, fr AS (SELECT station, 14 AS h, ds, y FROM f14 UNION ALL SELECT station, 30, ds, y FROM f30),
span AS (SELECT station, MAX(t) AS last_day FROM daily GROUP BY 1), deliveries AS (SELECT station, 1 AS delivery, last_day - 60 AS until FROM span WHERE station < '4' UNION ALL SELECT station, 2, last_day FROM span),
runs AS (SELECT d.station, f.h, d.delivery, COUNT(*) AS n_train, MAX(f.ds) AS trained_to, CAST(ROW_NUMBER() OVER (PARTITION BY d.station, f.h ORDER BY d.delivery) AS INTEGER) AS version
  FROM deliveries d JOIN fr f ON f.station = d.station AND f.ds <= d.until AND f.y IS NOT NULL GROUP BY 1, 2, 3),
grid AS ({' UNION ALL '.join(f"SELECT {i} AS config_id, {c['changepoint_prior_scale']!r}::DOUBLE AS cps, {c['seasonality_prior_scale']!r}::DOUBLE AS sps, {c['changepoint_range']!r}::DOUBLE AS share" for i, c in enumerate(tuning.grid_configs()))})"""


def _retrained(spark, sf_dir):
    """Two deliveries retrained one after the other: the second is 60 days longer and brings new stations."""
    raw = reuse(panels.merged(spark, sf_dir))
    last = F.max("t").over(Window.partitionBy(*K))
    first = raw.withColumn("_last", last).where((F.col("t") <= F.date_sub("_last", 60)) & (F.col("station") < "4")).drop("_last")
    grid = F.array(*[F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(str(v)))]) for c in tuning.grid_configs()])
    hs = F.explode(F.array(*[F.lit(h) for h in schemas.HORIZONS])).alias("h")
    tuned = raw.select("station").distinct().select("station", hs).withColumn("params", F.get(grid, F.expr(_CONFIG_OF)))
    store = scratch_path(spark, "models")
    return store, [retrain.retrain(features_of(delivery), K, "t", "level", REGRESSORS, store, tuned) for delivery in (first, raw)]


@query("retrain_versions", f"""{_VERSIONS_SQL}
SELECT r.station, r.h, r.version, r.n_train, r.trained_to, CASE WHEN r.version = 1 THEN 'tuning' ELSE 'production' END AS params_from,
  g.cps AS changepoint_prior_scale, g.sps AS seasonality_prior_scale, g.share AS changepoint_range,
  sha256(concat_ws('|', r.station, r.h, g.cps, g.sps, g.share, r.trained_to)) AS run_id,
  r.version = MAX(r.version) OVER (PARTITION BY r.station, r.h) AS is_production FROM runs r JOIN grid g ON g.config_id = {_CONFIG_OF}""")
def retrain_versions(spark, sf_dir):
    """The run table after two retrainings, and which version of each model is in production."""
    store, _ = _retrained(spark, sf_dir)
    on = ["station", "h"]
    keys = "station string, h int"
    live = retrain.production_runs(spark, store, keys, on).select(*on, "version", F.lit(True).alias("is_production"))
    runs = retrain.run_table(spark, store, keys).join(live, [*on, "version"], "left")
    return runs.select(
        *on, "version", "n_train", "trained_to", "params_from", *[F.col("params")[c].cast("double").alias(c) for c in retrain.PARAMS],
        "run_id", F.coalesce("is_production", F.lit(False)).alias("is_production"))


@query("retrain_summary", f"""{_VERSIONS_SQL} SELECT station, h, version AS new_version, CASE WHEN version > 1 THEN version - 1 END AS previous_version, n_train, trained_to, CAST(NULL AS VARCHAR) AS error
  FROM runs WHERE delivery = 2""")
def retrain_summary(spark, sf_dir):
    """What the second retraining reports."""
    _, (_, second) = _retrained(spark, sf_dir)
    return second.select("station", "h", "new_version", "previous_version", "n_train", "trained_to", "error")


@query("tuning_sink_roundtrip", " UNION ALL ".join(f"SELECT * FROM (WITH {_naive_sql(h)}, {_SUMMARY} SELECT station, model, {q6('rmse', 3)} AS rmse, {h} AS horizon FROM sm)" for h in schemas.HORIZONS))
def tuning_sink_roundtrip(spark, sf_dir):
    """Both horizons written as one table, a folder each; the root is the combined table."""
    parts = [_summary(spark, sf_dir, h).select("station", "model", r6("rmse", 3).alias("rmse"), F.lit(h).alias("horizon")) for h in schemas.HORIZONS]
    path = zones.write_tuning(union_frames(*parts), scratch_path(spark, "tuning"))
    return zones.read_zone(spark, path)


@query("forecast_records", f"""WITH RECURSIVE {_SCORED_SQL} SELECT station, strftime(cutoff, '%Y-%m-%d') AS last_train, strftime(ds, '%Y-%m-%d') AS ds, {q6('yhat', 2)} AS yhat, {q6('lo', 2)} AS yhat_lower, {q6('hi', 2)} AS yhat_upper,
  COUNT(*) OVER (PARTITION BY station) AS n_points FROM forecast WHERE ds > cutoff""")
def forecast_records(spark, sf_dir):
    """The record of each station's forecast, read back point by point."""
    scored = reuse(_scored_forecast(spark, sf_dir))
    last = scored.groupBy(*K).agg(F.max("cutoff").alias("last_train"))
    ahead = frames.split_forecast(scored.select(*K, "ds", "yhat", "yhat_lower", "yhat_upper"), last, K).where("part = 'future'")
    records = zones.forecast_record(ahead, last, K)
    shape = "struct<last_train:string,points:array<struct<ds:string,yhat:double,yhat_lower:double,yhat_upper:double>>>"
    parsed = records.select("station", F.from_json("record", shape).alias("r"))
    points = parsed.select("station", "r.last_train", F.size("r.points").cast("long").alias("n_points"), F.inline("r.points"))
    return points.withColumns({c: r6(c, 2) for c in ("yhat", "yhat_lower", "yhat_upper")})
