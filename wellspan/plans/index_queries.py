"""Queries on standardised indices, events and lag structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspan import schemas
from wellspan.functions.labels import severity_color, severity_label
from wellspan.operators import calendar as cal, events, indices, joins, lagcorr, rolling
from wellspan.operators.clean import conform_daily, with_water_balance
from wellspan.plans.registry import (
    MERGED, MONTHLY_LEVEL, OBS, SPLI, WX, calendar, months, ppf_sql, q6, query, r6, score_sql, with_,
)
from wellspan.plans import daily_build
from wellspan.plans.daily_queries import FIRST_READING, gappy_readings
from wellspan.plans.features import feature_table as build_feature_table
from wellspan.plans.reports import drought_report as build_drought_report
from wellspan.session import reuse, scratch_path
from wellspan.sources import panels

K = ["station"]
S = schemas.IndexSpec
PANEL = [
    S("SPLI", "level", "mean"), S("SPI", "precip", "sum"), S("SETI", "et0", "sum"), S("SSTI", "soil_temp", "sum"),
    S("SSRI", "radiation", "sum"), S("SWSI", "wind", "sum"), S("SCCI", "cloud", "sum"),
    S("SPMI", "pressure", "sum"), S("SPEI", "Peff", "sum"), S("SSMI", "soil_moist", "mean"),
]
NAMES = [s.name for s in PANEL]


def merged_balance(spark, sf_dir):
    return with_water_balance(panels.merged(spark, sf_dir), "precip", "et0")


def _panel_sql(base: str = MERGED) -> str:
    value = {s.name: ("AVG(m.%s)" if s.agg == "mean" else "COALESCE(SUM(m.%s), 0)") % s.column for s in PANEL}
    wide = ", ".join(f"{v} AS {n}" for n, v in value.items())
    long = "\n UNION ALL ".join(
        f"SELECT station, month, '{s.name}' AS index_name, '{s.agg}' AS agg, {s.name} AS m FROM wide" for s in PANEL
    )
    acc = []
    for k in schemas.SCALES:
        pick = "m" if k == 1 else (
            f"CASE WHEN COUNT(m) OVER w{k} < {k} THEN NULL WHEN agg = 'sum' THEN SUM(m) OVER w{k} ELSE AVG(m) OVER w{k} END"
        )
        acc.append(
            f"SELECT station, month, index_name, {k} AS scale, {pick} AS value FROM long "
            f"WINDOW w{k} AS (PARTITION BY station, index_name ORDER BY month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        )
    scaled = "\n UNION ALL ".join(acc)
    return f"""{base}, mb AS (SELECT *, precip - et0 AS Peff FROM merged), {months('mb')},
wide AS (SELECT s.station, s.month, {wide} FROM cal_m s LEFT JOIN mb m
  ON m.station = s.station AND CAST(date_trunc('month', m.t) AS DATE) = s.month GROUP BY 1, 2),
long AS ({long}),
scaled AS ({scaled}),
{score_sql('scaled', 'panel', 'station, index_name, scale')}"""


PANEL_SQL = _panel_sql()


def panel_of(spark, sf_dir, scales=schemas.SCALES):
    return indices.index_panel(merged_balance(spark, sf_dir), K, "t", PANEL, scales)


def level_index(spark, sf_dir, scale=1):
    return indices.standardized_index(panels.obs(spark, sf_dir), K, "t", "level", "mean", scale)


@query("spli_monthly", f"WITH {SPLI} SELECT station, month, {q6('value', 4)} AS value, {q6('z')} AS z FROM spli")
def spli_monthly(spark, sf_dir):
    return level_index(spark, sf_dir).select("station", "month", r6("value", 4).alias("value"), r6("z").alias("z"))


@query("spli_supplier_network", f"""
WITH obs AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS t,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS level FROM lineitem GROUP BY 1, 2),
{MONTHLY_LEVEL}, {score_sql('monthly', 'spli')}
SELECT station, month, {q6('z')} AS z FROM spli""")
def spli_supplier_network(spark, sf_dir):
    rows = indices.standardized_index(panels.supplier_levels(spark, sf_dir), K, "t", "level")
    return rows.select("station", "month", r6("z").alias("z"))


@query("index_panel_scales", f"WITH {PANEL_SQL} SELECT station, month, index_name, CAST(scale AS INTEGER) AS scale, {q6('z')} AS z FROM panel")
def index_panel_scales(spark, sf_dir):
    return panel_of(spark, sf_dir).select("station", "month", "index_name", "scale", r6("z").alias("z"))


@query("index_panel_wide", f"""WITH {PANEL_SQL} SELECT station, month,
  {', '.join(f"{q6(f'''MAX(CASE WHEN index_name = '{n}' AND scale = {k} THEN z END)''')} AS {n}_{k}" for n in NAMES for k in schemas.SCALES)}
FROM panel GROUP BY 1, 2""")
def index_panel_wide(spark, sf_dir):
    names = [f"{n}-{k}" for n in NAMES for k in schemas.SCALES]
    wide = indices.pivot_panel(panel_of(spark, sf_dir), K, names)
    return wide.select("station", "month", *[r6(F.col(f"`{n}`")).alias(n.replace("-", "_")) for n in names])


@query("index_broadcast_daily", f"""WITH {PANEL_SQL},
j AS (SELECT d.station, d.t, {', '.join(f"(SELECT z FROM panel p WHERE p.station = d.station AND p.month = CAST(date_trunc('month', d.t) AS DATE) AND p.index_name = '{n}' AND p.scale = 3) AS {n}" for n in NAMES)} FROM mb d)
SELECT station, t, {', '.join(f"{q6(f'COALESCE({n}, AVG({n}) OVER (PARTITION BY station))')} AS {n}" for n in NAMES)} FROM j""")
def index_broadcast_daily(spark, sf_dir):
    daily = reuse(merged_balance(spark, sf_dir))
    panel = indices.index_panel(daily, K, "t", PANEL, (3,))
    wide = indices.pivot_panel(panel, K, NAMES, scale=3)
    out = indices.attach_indices(daily.select("station", "t"), wide, K, "t", NAMES)
    return out.select("station", "t", *[r6(n).alias(n) for n in NAMES])


@query("causal_index_asof", f"""WITH {SPLI},
c AS (SELECT station, month, LAG(z) OVER (PARTITION BY station ORDER BY month) AS z_prev FROM spli)
SELECT o.station, o.t, {q6('c.z_prev')} AS z_prev FROM obs o ASOF LEFT JOIN c
  ON o.station = c.station AND o.t >= c.month""")
def causal_index_asof(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir))
    monthly = indices.standardized_index(daily, K, "t", "level")
    return indices.causal_index(daily, monthly, K, "t").select("station", "t", r6("z_prev").alias("z_prev"))


@query("index_forward_filled_asof", f"""WITH {SPLI}
SELECT o.station, o.t, {q6('c.z')} AS z FROM obs o ASOF LEFT JOIN spli c
  ON o.station = c.station AND o.t >= c.month""")
def index_forward_filled_asof(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir))
    monthly = indices.standardized_index(daily, K, "t", "level").select("station", "month", "z")
    return joins.asof_month(daily, monthly, K, "t", ["z"]).select("station", "t", r6("z").alias("z"))


# (bound, bound included, label)
SEVERITY_LIMITS = """(-2.0, true, 'Extreme drought'), (-1.5, true, 'Severe drought'), (-1.0, true, 'Moderate drought'),   (1.0, false, 'Normal'), (1.5, false, 'Moderately wet'), (2.0, false, 'Very wet'),   (1e9, false, 'Extremely wet')"""


@query("severity_labels", f"""WITH {SPLI}, lim(b, incl, label, color) AS (VALUES
  (-2.0, true, 'Extreme drought', '#67001f'), (-1.5, true, 'Severe drought', '#b2182b'), (-1.0, true, 'Moderate drought', '#ef8a62'),
  (1.0, false, 'Normal', '#4d4d4d'), (1.5, false, 'Moderately wet', '#67a9cf'), (2.0, false, 'Very wet', '#2166ac'),
  (1e9, false, 'Extremely wet', '#053061'))
SELECT s.station, s.month,
  (SELECT arg_min(label, b) FROM lim WHERE s.z < b OR (incl AND s.z = b)) AS label,
  (SELECT arg_min(color, b) FROM lim WHERE s.z < b OR (incl AND s.z = b)) AS color,
  (SELECT arg_min(label, b) FROM lim WHERE 2.2 * s.z < b OR (incl AND 2.2 * s.z = b)) AS label_stretched,
  (SELECT arg_min(color, b) FROM lim WHERE 2.2 * s.z < b OR (incl AND 2.2 * s.z = b)) AS color_stretched FROM spli s""")
def severity_labels(spark, sf_dir):
    """Labels of the index, and of the index stretched until all seven classes occur."""
    z, wide = F.col("z"), F.col("z") * 2.2
    return level_index(spark, sf_dir).select(
        "station", "month", severity_label(z).alias("label"), severity_color(z).alias("color"),
        severity_label(wide).alias("label_stretched"), severity_color(wide).alias("color_stretched"),
    )


FORECAST_POOL = """m AS (SELECT station, CAST(date_trunc('month', t) AS DATE) AS month, AVG(level) AS mean_level,
   AVG(level) FILTER (fc = 0) AS hist, COUNT(*) FILTER (fc = 0) AS obs_days, COUNT(*) FILTER (fc = 1) AS fc_days FROM both_ GROUP BY 1, 2),
tm AS (SELECT * FROM m WHERE fc_days > 0 AND (obs_days > 0 OR fc_days > 14)),
pooled AS (SELECT tm.station, tm.month, tm.mean_level, tm.obs_days, tm.fc_days,
   (COUNT(*) FILTER (round(p.hist, 8) < round(tm.mean_level, 8)) + (COUNT(*) FILTER (round(p.hist, 8) = round(tm.mean_level, 8)) + 2) / CAST(2 AS DOUBLE) - CAST(0.44 AS DOUBLE))
   / (COUNT(p.hist) + 2 - CAST(0.88 AS DOUBLE)) AS p
  FROM tm LEFT JOIN m p ON p.station = tm.station AND month(p.month) = month(tm.month) AND p.month <> tm.month AND p.hist IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5)"""


# forecast = the level of the same day one year earlier, for 60 days after the last one
_FC = f"""{OBS}, last AS (SELECT station, MAX(t) - 45 AS last_train FROM obs GROUP BY 1),
seen AS (SELECT o.station, o.t, o.level FROM obs o JOIN last l USING (station) WHERE o.t <= l.last_train),
ahead AS (SELECT o.station, o.t, o.level * 0.97 AS level FROM obs o JOIN last l USING (station) WHERE o.t > l.last_train),
both_ AS (SELECT *, 0 AS fc FROM seen UNION ALL SELECT *, 1 FROM ahead),
{FORECAST_POOL}"""


@query("forecast_month_index", f"""WITH {_FC}, {ppf_sql('pooled', 'scored')}
SELECT station, month, {q6('z')} AS spli, {q6('mean_level', 4)} AS mean_level, obs_days, fc_days,
  CAST(day(last_day(month)) AS INTEGER) AS days_in_month, CASE WHEN obs_days > 0 THEN 'blended' ELSE 'forecast-only' END AS mode FROM scored""")
def forecast_month_index(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir).withColumnRenamed("t", "ds"))
    last = daily.groupBy("station").agg(F.date_sub(F.max("ds"), 45).alias("last_train"))
    cut = daily.join(last, "station")
    observed = cut.where("ds <= last_train").select("station", "ds", F.col("level").alias("y"))
    forecast = cut.where("ds > last_train").select("station", "ds", (F.col("level") * 0.97).alias("yhat"))
    out = indices.forecast_index(observed, forecast, last, K)
    return out.withColumns({"spli": r6("spli"), "mean_level": r6("mean_level", 4)})


def _events_sql(src: str, thr: float, direction: str, min_gap: int, keys: str = "station", out: str = "ev") -> str:
    """Runs by row-number difference, then merged while the month gap is small."""
    op, sign = ("<", 1) if direction == "below" else (">", -1)
    return f"""{out}_rows AS (SELECT {keys}, month, z, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY month) AS rn FROM {src} WHERE z IS NOT NULL),
{out}_hits AS (SELECT *, rn - ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY month) AS grp FROM {out}_rows WHERE z {op} {thr}),
{out}_runs AS (SELECT {keys}, MIN(month) AS s, MAX(month) AS e, MIN(rn) AS r0, MAX(rn) AS r1 FROM {out}_hits GROUP BY {keys}, grp),
{out}_gap AS (SELECT *, date_diff('month', LAG(e) OVER (PARTITION BY {keys} ORDER BY s), s) AS gap FROM {out}_runs),
{out}_no AS (SELECT *, CAST(SUM(CASE WHEN gap IS NULL OR gap > {min_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s) AS BIGINT) AS event_no FROM {out}_gap),
{out}_span AS (SELECT {keys}, event_no, MIN(s) AS s, MAX(e) AS e, CAST(MAX(r1) - MIN(r0) + 1 AS BIGINT) AS duration_m FROM {out}_no GROUP BY {keys}, event_no),
{out} AS (SELECT {', '.join('v.' + k.strip() for k in keys.split(','))}, v.event_no, v.s AS start, v.e AS "end", MAX(v.duration_m) AS duration_m,
   round_even({sign} * MIN({sign} * w.z), 2) AS peak, round_even(SUM(greatest({sign} * ({thr} - w.z), 0)), 2) AS severity,
   round_even(SUM(greatest({sign} * ({thr} - w.z), 0)) / MAX(v.duration_m), 2) AS mean_intensity,
   arg_min(w.month, {sign} * round(w.z, 9) + date_diff('month', v.s, w.month) * 1e-10) AS peak_date
  FROM {out}_span v JOIN {out}_rows w ON {' AND '.join(f'w.{k.strip()} = v.{k.strip()}' for k in keys.split(','))} AND w.month BETWEEN v.s AND v.e
  GROUP BY ALL)"""


_EVENT_COLUMNS = """station, event_no, start, "end", duration_m, peak + 0.0 AS peak, severity + 0.0 AS severity, mean_intensity + 0.0 AS mean_intensity, peak_date"""


@query("drought_events", f"WITH {SPLI}, {_events_sql('spli', -1.0, 'below', 1)} SELECT {_EVENT_COLUMNS} FROM ev")
def drought_events(spark, sf_dir):
    return events.characterize_events(level_index(spark, sf_dir), K, "month", "z", -1.0)


@query("drought_events_pooled", f"WITH {SPLI}, {_events_sql('spli', -1.0, 'below', 2)} SELECT {_EVENT_COLUMNS} FROM ev")
def drought_events_pooled(spark, sf_dir):
    return events.characterize_events(level_index(spark, sf_dir), K, "month", "z", -1.0, min_gap=2)


@query("wet_events", f"WITH {SPLI}, {_events_sql('spli', 1.0, 'above', 1)} SELECT {_EVENT_COLUMNS} FROM ev")
def wet_events(spark, sf_dir):
    return events.characterize_events(level_index(spark, sf_dir), K, "month", "z", 1.0, "above")


def _level_panel_sql() -> str:
    acc = "\n UNION ALL ".join(
        f"""SELECT station, month, {k} AS scale, CASE WHEN COUNT(value) OVER w{k} = {k} THEN AVG(value) OVER w{k} END AS value FROM monthly
WINDOW w{k} AS (PARTITION BY station ORDER BY month ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)""" for k in schemas.SCALES
    )
    return f"{OBS}, {MONTHLY_LEVEL}, scaled AS ({acc}), {score_sql('scaled', 'lp', 'station, scale')}, {_events_sql('lp', -1.0, 'below', 1, 'station, scale')}"


@query("event_extremes_by_scale", f"""WITH {_level_panel_sql()},
x AS (SELECT *, 'longest' AS kind FROM ev QUALIFY ROW_NUMBER() OVER (PARTITION BY station, scale ORDER BY duration_m DESC, start) = 1
 UNION ALL SELECT *, 'most_intense' FROM ev QUALIFY ROW_NUMBER() OVER (PARTITION BY station, scale ORDER BY peak, start) = 1)
SELECT station, CAST(scale AS INTEGER) AS scale, kind, start, "end", duration_m, peak, severity + 0.0 AS severity,
  CASE WHEN peak <= -2 THEN 'Extreme drought' WHEN peak <= -1.5 THEN 'Severe drought' WHEN peak <= -1 THEN 'Moderate drought' END AS severity_class FROM x""")
def event_extremes_by_scale(spark, sf_dir):
    report = build_drought_report(panels.obs(spark, sf_dir), K, "t", "level", threshold=-1.0)
    return report.select("station", "scale", "kind", "start", "end", "duration_m", "peak", "severity", "severity_class")


@query("level_runs", f"""WITH {SPLI}, f AS (SELECT station, month, z < 0 AS dry, ROW_NUMBER() OVER (PARTITION BY station ORDER BY month) AS rn FROM spli WHERE z IS NOT NULL),
g AS (SELECT *, rn - ROW_NUMBER() OVER (PARTITION BY station, dry ORDER BY month) AS grp FROM f)
SELECT station, month, dry, COUNT(*) OVER (PARTITION BY station, dry, grp) AS run_size,
  rn = MIN(rn) OVER (PARTITION BY station, dry, grp) AND dry AS run_start, rn = MAX(rn) OVER (PARTITION BY station, dry, grp) AND dry AS run_end FROM g""")
def level_runs(spark, sf_dir):
    rows = level_index(spark, sf_dir).where("z is not null").select("station", "month", (F.col("z") < 0).alias("dry"))
    rows = events.run_ids(rows, K, "month", "dry")
    return events.run_bounds(rows, K, "month", "dry").drop("run_id")


# the warm-day threshold by circular distance, a theta join
_HEAT = f"""{WX}, dd AS (SELECT station, t, tmax, dayofyear(t) AS doy FROM wx), ring AS (SELECT CAST(range AS INTEGER) AS doy FROM range(1, 367)),
thr AS (SELECT d.station, r.doy, quantile_cont(d.tmax, 0.9) AS threshold FROM dd d JOIN ring r
  ON least(abs(d.doy - r.doy), 366 - abs(d.doy - r.doy)) <= 15 GROUP BY 1, 2),
{calendar('wx')}, hot AS (SELECT c.station, c.t, d.tmax, h.threshold, COALESCE(d.tmax > h.threshold, false) AS hot
  FROM cal c LEFT JOIN dd d ON d.station = c.station AND d.t = c.t LEFT JOIN thr h ON h.station = c.station AND h.doy = dayofyear(c.t)),
g AS (SELECT *, date_diff('day', DATE '1990-01-01', t) - ROW_NUMBER() OVER (PARTITION BY station, hot ORDER BY t) AS grp FROM hot),
hw AS (SELECT *, hot AND COUNT(*) OVER (PARTITION BY station, hot, grp) >= {{n}} AS heatwave FROM g)"""


@query("doy_percentile_ring", f"WITH {_HEAT.format(n=3)} SELECT station, doy, {q6('threshold')} AS threshold FROM thr")
def doy_percentile_ring(spark, sf_dir):
    rows = events.doy_percentile(panels.wx(spark, sf_dir), K, "t", "tmax")
    return rows.withColumn("threshold", r6("threshold"))


@query("heatwave_days", f"WITH {_HEAT.format(n=3)} SELECT station, t, tmax, {q6('threshold')} AS threshold, hot, heatwave FROM hw")
def heatwave_days(spark, sf_dir):
    daily = reuse(panels.wx(spark, sf_dir).select("station", "t", "tmax"))
    return events.heatwave_days(daily, K, "t", "tmax", min_days=3).withColumn("threshold", r6("threshold"))


_COMPOUND = f"""WITH {SPLI}, {_HEAT.format(n=3)},
hm AS (SELECT station, CAST(date_trunc('month', t) AS DATE) AS month, bool_or(heatwave) AS heatwave, COUNT(*) FILTER (heatwave) AS heatwave_days FROM hw GROUP BY 1, 2),
comp AS (SELECT s.station, s.month, COALESCE(s.z < -1, false) AS drought, hm.heatwave, hm.heatwave_days FROM spli s JOIN hm ON hm.station = s.station AND hm.month = s.month)"""


def _compound(spark, sf_dir):
    wx = reuse(panels.wx(spark, sf_dir).select("station", "t", "tmax"))
    months_ = events.heatwave_months(events.heatwave_days(wx, K, "t", "tmax", min_days=3), K, "t")
    return events.compound_months(level_index(spark, sf_dir), months_, K)


@query("compound_dry_hot", f"{_COMPOUND} SELECT station, month, drought, heatwave, drought AND heatwave AS compound FROM comp")
def compound_dry_hot(spark, sf_dir):
    return _compound(spark, sf_dir)


@query("compound_contingency", f"""{_COMPOUND} SELECT station, drought, COUNT(*) FILTER (NOT heatwave) AS heatwave_false,
  COUNT(*) FILTER (heatwave) AS heatwave_true FROM comp GROUP BY 1, 2""")
def compound_contingency(spark, sf_dir):
    return events.crosstab(_compound(spark, sf_dir), K, "drought", "heatwave", [False, True])


def _ccf_sql(src: str, keys: str, maxlag: int = 12) -> str:
    """Lags as rows by a self-join on the row number."""
    on = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"""al AS (SELECT {keys}, value, response, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY month) AS rn FROM {src} WHERE value IS NOT NULL AND response IS NOT NULL),
lags AS (SELECT CAST(range AS INTEGER) AS lag FROM range(0, {maxlag + 1})),
prof AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, l.lag,
  covar_samp(a.value, b.response) / nullif(stddev_samp(CASE WHEN b.response IS NOT NULL THEN a.value END) * stddev_samp(b.response), 0) AS r
  FROM al a CROSS JOIN lags l LEFT JOIN al b ON {on} AND b.rn = a.rn + l.lag GROUP BY ALL)"""


_PAIRS = f"""WITH {PANEL_SQL}, pairs AS (SELECT d.station, d.index_name AS driver, d.month, d.z AS value, s.z AS response
  FROM panel d JOIN panel s ON s.station = d.station AND s.month = d.month AND s.scale = 1 AND s.index_name = 'SPLI'
  WHERE d.scale = 1 AND d.index_name <> 'SPLI'), {_ccf_sql('pairs', 'station, driver')}"""


def _profile(spark, sf_dir):
    pairs = lagcorr.index_driver_pairs(panel_of(spark, sf_dir, (1,)), K, "SPLI")
    return lagcorr.cross_correlation(pairs, ["station", "driver"], "month", "value", "response")


@query("ccf_drivers", f"{_PAIRS} SELECT station, driver, lag, {q6('r')} AS r FROM prof")
def ccf_drivers(spark, sf_dir):
    return _profile(spark, sf_dir).withColumn("r", r6("r"))


@query("best_recharge_lag", f"""{_PAIRS} SELECT station, driver, lag, {q6('r')} AS r FROM prof p
WHERE r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prof o WHERE o.station = p.station AND o.driver = p.driver
  AND (o.r > p.r OR (o.r = p.r AND o.lag < p.lag)))""")
def best_recharge_lag(spark, sf_dir):
    return lagcorr.best_lag(_profile(spark, sf_dir), ["station", "driver"]).withColumn("r", r6("r"))


# the fixed map of raw drivers under the panel's column names
_PANEL_NAME = {"shortwave_radiation_sum": "radiation", "et0_fao_evapotranspiration": "et0", "cloud_cover_mean": "cloud",
               "wind_speed_10m_mean": "wind", "soil_temperature_0_to_100cm_mean": "soil_temp"}
_RAW_AGG = {_PANEL_NAME.get(c, c): how for c, how in schemas.DRIVER_AGG.items()}


def _rolled_driver(name: str, source: str, n: int, how: str) -> str:
    w = f"(PARTITION BY station ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({source}) OVER {w} = {n} THEN {how}({source}) OVER {w} END AS {name}"


_ROLLED = [("P_cum_30d", "precip", 30, "SUM"), ("P_cum_90d", "precip", 90, "SUM"), ("Peff_cum_30d", "Peff", 30, "SUM"),
           ("Peff_cum_90d", "Peff", 90, "SUM"), ("Temperature_mean_90d", "soil_temp", 90, "AVG")]
_MONTH_VALUE = {"sum": "COALESCE(SUM({c}), 0)", "mean": "AVG({c})", "last": "arg_max({c}, m.t) FILTER ({c} IS NOT NULL)"}
_RAW = f"""WITH {MERGED}, mb AS (SELECT *, precip - et0 AS Peff FROM merged),
md AS (SELECT *, {', '.join(_rolled_driver(*r) for r in _ROLLED)} FROM mb),
me AS (SELECT * REPLACE (round_even(Temperature_mean_90d, 2) AS Temperature_mean_90d,
  {', '.join(f"COALESCE({n}, FIRST_VALUE({n} IGNORE NULLS) OVER w) AS {n}" for n, *_ in _ROLLED[:4])}) FROM md
  WINDOW w AS (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
mf AS (SELECT * REPLACE (COALESCE(Temperature_mean_90d, FIRST_VALUE(Temperature_mean_90d IGNORE NULLS) OVER w) AS Temperature_mean_90d) FROM me
  WINDOW w AS (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), {months('mf')},
w AS (SELECT s.station, s.month, AVG(level) AS response, {', '.join(f"{_MONTH_VALUE[how].format(c=c)} AS {c}" for c, how in _RAW_AGG.items())}
  FROM cal_m s LEFT JOIN mf m ON m.station = s.station AND CAST(date_trunc('month', m.t) AS DATE) = s.month GROUP BY 1, 2),
pairs AS (SELECT station, month, driver, value, response FROM w UNPIVOT INCLUDE NULLS (value FOR driver IN ({', '.join(_RAW_AGG)}))),
{_ccf_sql('pairs', 'station, driver', 6)}"""


@query("ccf_raw_drivers", f"{_RAW} SELECT station, driver, lag, {q6('r')} AS r FROM prof")
def ccf_raw_drivers(spark, sf_dir):
    daily = rolling.water_balance_features(panels.merged(spark, sf_dir), K, "t", "precip", "et0", "soil_temp")
    pairs = lagcorr.raw_driver_pairs(daily, K, "t", "level", _RAW_AGG)
    return lagcorr.cross_correlation(pairs, ["station", "driver"], "month", "value", "response", 6).withColumn("r", r6("r"))


@query("index_checks", f"""WITH {PANEL_SQL}, g AS (SELECT station, index_name, scale, AVG(z) AS mean_z, STDDEV_SAMP(z) AS std_z, MIN(z) AS lo FROM panel GROUP BY 1, 2, 3)
SELECT station, index_name, CAST(scale AS INTEGER) AS scale, {q6('mean_z')} AS mean_z, {q6('std_z')} AS std_z,
  (SELECT MIN(p.month) FROM panel p WHERE p.station = g.station AND p.index_name = g.index_name AND p.scale = g.scale AND p.z = g.lo) AS worst_month,
  COALESCE(abs(mean_z) < 0.15 AND std_z > 0.8 AND std_z < 1.2, false) AS ok FROM g""")
def index_checks(spark, sf_dir):
    rows = indices.index_checks(panel_of(spark, sf_dir), K)
    return rows.withColumns({"mean_z": r6("mean_z"), "std_z": r6("std_z")})


# level on a straight line between known days, then the same features and indices on that
CONFORMED = f"""{OBS}, {WX}, raw AS (SELECT wx.* REPLACE (round_even(soil_temp * 16, 0) / 16 AS soil_temp), obs.level FROM wx LEFT JOIN obs ON wx.station = obs.station AND wx.t = obs.t),
ln AS (SELECT *, MAX(CASE WHEN level IS NOT NULL THEN t END) OVER (PARTITION BY station ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0,
  MIN(CASE WHEN level IS NOT NULL THEN t END) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM raw),
merged AS (SELECT n.* EXCLUDE (level, t0, t1), n.level IS NOT NULL AS is_observed,
  CASE WHEN n.t0 IS NULL THEN NULL WHEN n.t1 IS NULL OR n.t0 = n.t1 THEN a.level ELSE (b.level - a.level) / (n.t1 - n.t0) * (n.t - n.t0) + a.level END AS level
  FROM ln n LEFT JOIN raw a ON a.station = n.station AND a.t = n.t0 LEFT JOIN raw b ON b.station = n.station AND b.t = n.t1)"""


ROLLED_FEATURES = ["P_cum_30d", "P_cum_90d", "Peff_cum_30d", "Peff_cum_90d", "Temperature_mean_30d", "Temperature_mean_90d"]


def first_filled(name: str) -> str:
    source = "precip" if name.startswith("P_") else "Peff" if name.startswith("Peff") else "soil_temp"
    n, how = int(name[-3:-1]), "AVG" if "mean" in name else "SUM"
    w = f"(PARTITION BY station ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    value = f"CASE WHEN COUNT({source}) OVER {w} = {n} THEN {how}({source}) OVER {w} END"
    return f"{f'round_even({value}, 2)' if how == 'AVG' else value} AS {name}"


_FEATURE_SQL = f"""WITH {_panel_sql(CONFORMED)},
f AS (SELECT *, {', '.join(map(first_filled, ROLLED_FEATURES))} FROM mb),
z AS (SELECT f.*, {', '.join(f"(SELECT p.z FROM panel p WHERE p.station = f.station AND p.scale = 1 AND p.index_name = '{n}' AND p.month = CAST(date_trunc('month', f.t) AS DATE)) AS z_{n}" for n in NAMES)} FROM f)
SELECT station AS code_bss, t AS date_index, is_observed, {q6('level', 3)} AS niveau_nappe_eau,
  {', '.join(f"{q6(f'COALESCE({n}, FIRST_VALUE({n} IGNORE NULLS) OVER w)', 3)} AS {n}" for n in ROLLED_FEATURES)},
  {', '.join(f"{q6(f'COALESCE(z_{n}, AVG(z_{n}) OVER (PARTITION BY station))')} AS {n}" for n in NAMES)}
FROM z WINDOW w AS (PARTITION BY station ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query("daily_feature_table", _FEATURE_SQL)
def daily_feature_table(spark, sf_dir):
    named = panels.named(sixteenths(panels.merged(spark, sf_dir)))
    return _feature_columns(build_feature_table(named, ["code_bss"], "date_index"))


def sixteenths(df):
    """Temperatures whose sums are exact, so that two engines round a mean to the same hundredth."""
    return df.withColumn("soil_temp", F.rint(F.col("soil_temp") * 16) / 16)


def _feature_columns(table):
    return table.select(
        "code_bss", "date_index", "is_observed",
        *[r6(c, 3).alias(c) for c in ("niveau_nappe_eau", *ROLLED_FEATURES)], *[r6(n).alias(n) for n in NAMES],
    )


def _deliveries(spark, sf_dir):
    """Readings as two deliveries under the feed's names: open orders come later."""
    rows = panels.readings(spark, sf_dir).withColumnsRenamed({"station": "code_bss", "t": "date_index", "level": "niveau_nappe_eau"})
    return [rows.where("status <> 'O'").drop("status"), rows.where("status = 'O'").drop("status")]


_LAST_READING = """obs AS (SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_totalprice AS level FROM orders
  QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderstatus = 'O' DESC, o_orderkey DESC) = 1)"""


@query("daily_build_two_deliveries", _FEATURE_SQL.replace(OBS, _LAST_READING))
def daily_build_two_deliveries(spark, sf_dir):
    weather = panels.named(sixteenths(panels.wx(spark, sf_dir)))
    return _feature_columns(daily_build.daily_build(
        _deliveries(spark, sf_dir), weather, scratch_path(spark, "build"), "code_bss", "date_index", ["seq"]))


@query("daily_build_next_chunks", """
WITH s AS (SELECT o_orderpriority AS code_bss, MAX(CAST(o_orderdate AS DATE)) AS e,
  MAX(CAST(o_orderdate AS DATE)) FILTER (year(o_orderdate) < 2000) AS last_date FROM orders GROUP BY 1),
r AS (SELECT code_bss, e, COALESCE(CAST(last_date + INTERVAL 1 DAY AS DATE), DATE '1990-01-01') AS b FROM s)
SELECT code_bss, CAST(y AS INTEGER) AS year, greatest(b, make_date(y, 1, 1)) AS chunk_start, least(e, make_date(y, 12, 31)) AS chunk_end
FROM (SELECT *, UNNEST(range(year(b), year(e) + 1)) AS y FROM r WHERE b <= e)""")
def daily_build_next_chunks(spark, sf_dir):
    """After a delivery of the years before 2000: what is left to fetch, up to the last day of each station."""
    first, second = _deliveries(spark, sf_dir)
    path = scratch_path(spark, "build")
    readings = first.unionByName(second)
    daily_build.load([readings.where(F.year("date_index") < 2000)], path, "code_bss", "date_index", ["seq"])
    ends = readings.groupBy("code_bss").agg(F.max("date_index").alias("last_known"))
    return daily_build.next_chunks(ends, path, first.schema, "code_bss", "date_index", F.lit("1990-01-01").cast("date"), "last_known")


@query("feature_table_raw_readings", _FEATURE_SQL.replace(OBS, f"obs AS {FIRST_READING}"))
def feature_table_raw_readings(spark, sf_dir):
    """The feature table from readings as they land: several a day, some without a level."""
    rows = panels.wx(spark, sf_dir).join(gappy_readings(spark, sf_dir), ["station", "t"], "left")
    return _feature_columns(build_feature_table(panels.named(sixteenths(rows)), ["code_bss"], "date_index", order=["seq"]))
