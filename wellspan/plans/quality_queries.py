"""Queries on profiles, correlation, seasonality and decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from wellspan.operators import calendar as cal, clean, decompose, joins, quality
from wellspan.plans.index_queries import level_index
from wellspan.plans.registry import (
    MERGED, OBS, SPLI, WX, calendar, q6, query, r6, with_,
)
from wellspan.plans.index_queries import _events_sql
from wellspan.plans.reports import analysis_extract, level_feature_pairs as pairs_of, recent_window as recent
from wellspan.session import reuse
from wellspan.sources import panels

K = ["station"]
WX_COLUMNS = ["precip", "et0", "soil_temp", "soil_moist", "radiation", "wind", "cloud", "pressure", "tmax"]

INTERPOLATED = f"""{OBS}, {calendar('obs')}, near AS (
  SELECT c.station, c.t, o.level,
    (SELECT MAX(p.t) FROM obs p WHERE p.station = c.station AND p.t <= c.t) AS t0,
    (SELECT MIN(p.t) FROM obs p WHERE p.station = c.station AND p.t >= c.t) AS t1
  FROM cal c LEFT JOIN obs o ON o.station = c.station AND o.t = c.t),
dense AS (SELECT n.station, n.t, CASE WHEN n.t0 = n.t1 THEN a.level ELSE (b.level - a.level) / (n.t1 - n.t0) * (n.t - n.t0) + a.level END AS y
  FROM near n JOIN obs a ON a.station = n.station AND a.t = n.t0 JOIN obs b ON b.station = n.station AND b.t = n.t1)"""


def dense_levels(spark, sf_dir):
    """Interpolated level on every calendar day."""
    return clean.interpolate_linear(cal.densify(panels.obs(spark, sf_dir), K, "t"), K, "t", ["level"])


@query("value_counts_desc", """
SELECT o_orderpriority AS station, o_orderstatus AS status, COUNT(*) AS n FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2""")
def value_counts_desc(spark, sf_dir):
    return quality.value_counts(panels.readings(spark, sf_dir), ["station", "status"])


_PROFILE = " UNION ALL ".join(
    f"""SELECT station, '{c}' AS "column", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, 100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*) AS pct_null
  FROM merged GROUP BY 1""" for c in ("level", *WX_COLUMNS)
)


@query("null_profile", f"{with_(MERGED)} {_PROFILE}")
def null_profile(spark, sf_dir):
    return quality.null_profile(panels.merged(spark, sf_dir), ["level", *WX_COLUMNS], K)


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT station, '{c}' AS "column", COUNT({c}) AS n, {q6(f'AVG({c})', 4)} AS mean, {q6(f'STDDEV_SAMP({c})', 4)} AS std,
  CAST(MIN({c}) AS DOUBLE) AS min, {q6(f'quantile_cont({c}, 0.25)', 4)} AS q25, {q6(f'quantile_cont({c}, 0.5)', 4)} AS q50,
  {q6(f'quantile_cont({c}, 0.75)', 4)} AS q75, CAST(MAX({c}) AS DOUBLE) AS max FROM merged GROUP BY 1""" for c in ("level", *WX_COLUMNS)
)


@query("describe_exact", f"{with_(MERGED)} {_DESCRIBE}")
def describe_exact(spark, sf_dir):
    rows = quality.describe(panels.merged(spark, sf_dir), K, ["level", *WX_COLUMNS])
    return rows.withColumns({c: r6(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("exact_quantiles_prices", f"""
SELECT l_returnflag, 'l_extendedprice' AS "column", q, {q6('v')} AS value FROM (
  SELECT l_returnflag, UNNEST([0.1, 0.25, 0.5, 0.9, 0.99])::DOUBLE AS q, UNNEST(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.9, 0.99])) AS v
  FROM lineitem GROUP BY 1)""")
def exact_quantiles_prices(spark, sf_dir):
    lines = panels.table(spark, sf_dir, "lineitem")
    out = quality.exact_quantiles(lines, "l_extendedprice", [0.1, 0.25, 0.5, 0.9, 0.99], ["l_returnflag"])
    return out.withColumn("value", r6("value"))


def _corr_sql(a: str, b: str, src: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"""(SELECT covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) FROM {src} WHERE {both})"""


_CORR_COLUMNS = ["level", *WX_COLUMNS]
_MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {_corr_sql(a, b, 'merged')} AS r" for a in _CORR_COLUMNS for b in _CORR_COLUMNS
)


@query("corr_matrix_long", f"{with_(MERGED)} SELECT var1, var2, {q6('r')} AS r FROM ({_MATRIX})")
def corr_matrix_long(spark, sf_dir):
    return quality.corr_matrix(panels.merged(spark, sf_dir), _CORR_COLUMNS).withColumn("r", r6("r"))


@query("strong_pairs", f"{with_(MERGED)} SELECT var1, var2, {q6('r')} AS r FROM ({_MATRIX}) WHERE var1 < var2 AND abs(r) > 0.7")
def strong_pairs(spark, sf_dir):
    rows = quality.strong_pairs(quality.corr_matrix(panels.merged(spark, sf_dir), _CORR_COLUMNS), 0.7)
    return rows.withColumn("r", r6("r"))


@query("collinear_report", f"""{with_(MERGED)} SELECT var1, var2, {q6('r')} AS r,
  CASE WHEN list_position({_CORR_COLUMNS!r}, var1) > list_position({_CORR_COLUMNS!r}, var2) THEN var1 ELSE var2 END AS drop_candidate
FROM ({_MATRIX}) WHERE var1 < var2 AND abs(r) > 0.7""")
def collinear_report(spark, sf_dir):
    return quality.collinear_report(panels.merged(spark, sf_dir), _CORR_COLUMNS, 0.7).withColumn("r", r6("r"))


_WITH = " UNION ALL ".join(
    f"SELECT station, '{c}' AS \"column\", covar_samp({c}, level) / nullif(stddev_samp({c}) FILTER (level IS NOT NULL) * stddev_samp(level), 0) AS r FROM merged GROUP BY 1"
    for c in WX_COLUMNS
)


@query("corr_with_target", f"{with_(MERGED)} SELECT station, \"column\", {q6('r')} AS r FROM ({_WITH})")
def corr_with_target(spark, sf_dir):
    rows = quality.corr_with(panels.merged(spark, sf_dir), WX_COLUMNS, "level", K)
    return rows.withColumn("r", r6("r"))


_FLAT = ["precip", "et0", "soil_temp", "soil_moist", "radiation", "wind", "cloud", "pressure", "tmax"]
_STUCK = " UNION ALL ".join(f"SELECT station, '{c}' AS \"column\", STDDEV_SAMP({c}) AS std FROM stuck GROUP BY 1" for c in [*_FLAT, "flat"])


@query("constant_columns", f"""{with_(WX)}, stuck AS (SELECT * REPLACE (CASE WHEN station < '3' THEN 7 ELSE wind END AS wind), 3 AS flat FROM wx)
SELECT station, "column", CAST(0 AS DOUBLE) AS std FROM ({_STUCK}) WHERE std = 0""")
def constant_columns(spark, sf_dir):
    """All nine variables and a constant one; the wind sensor of two stations is stuck."""
    rows = panels.wx(spark, sf_dir).withColumns({"wind": F.when(F.col("station") < "3", 7.0).otherwise(F.col("wind")), "flat": F.lit(3)})
    return quality.constant_columns(rows, [*_FLAT, "flat"], K)


_CONTRACT = {
    "orders": "o_orderkey bigint, o_orderpriority string, o_orderdate date, o_totalprice double, o_orderstatus string, o_depth double",
    "lineitem": "l_orderkey bigint, l_shipdate date, l_quantity bigint, l_discount double, l_humidity double",
    "events": "event_id bigint, ts timestamp, event_type string, value float, station string",
}
_CONTRACT_ROWS = ", ".join(f"('{t}', '{c.split()[0]}', '{c.split()[1]}')" for t, columns in _CONTRACT.items() for c in columns.split(", "))
_KIND = "CASE c.data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT' THEN 'float' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(c.data_type) END"


@query("column_contract", f"""WITH want(table_name, column_name, expected) AS (VALUES {_CONTRACT_ROWS}),
have AS (SELECT c.table_name, c.column_name, {_KIND} AS found FROM information_schema.columns c WHERE c.table_name IN ({', '.join(f"'{t}'" for t in _CONTRACT)}))
SELECT COALESCE(w.table_name, h.table_name) AS table_name, COALESCE(w.column_name, h.column_name) AS column_name, w.expected, h.found,
  CASE WHEN h.found IS NULL THEN 'missing' WHEN w.expected IS NULL THEN 'not asked for' WHEN w.expected = h.found THEN 'present' ELSE 'wrong type' END AS status
FROM want w FULL JOIN have h ON h.table_name = w.table_name AND h.column_name = w.column_name""")
def column_contract(spark, sf_dir):
    """Present, missing and wrongly typed columns of the landed tables."""
    return clean.column_contract({t: (panels.table(spark, sf_dir, t), T.StructType.fromDDL(c)) for t, c in _CONTRACT.items()}, spark)


@query("duplicate_dates", """
SELECT o_orderpriority AS station, COUNT(*) - COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_duplicates FROM orders GROUP BY 1""")
def duplicate_dates(spark, sf_dir):
    return quality.duplicate_dates(panels.readings(spark, sf_dir), K, "t")


@query("kpis", f"""WITH {SPLI}, {_events_sql('spli', -1.0, 'below', 1)}
SELECT o.station, COUNT(*) AS n_records, MIN(o.t) AS first_day, MAX(o.t) AS last_day,
  (SELECT COUNT(z) FROM spli s WHERE s.station = o.station) AS n_months, (SELECT COUNT(*) FROM ev e WHERE e.station = o.station) AS n_events
FROM obs o GROUP BY 1""")
def kpis(spark, sf_dir):
    return analysis_extract(reuse(panels.obs(spark, sf_dir)), K, "t", "level", threshold=-1.0)


_SCATTER = " UNION ALL ".join(
    f"SELECT station, t, level, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM merged WHERE level IS NOT NULL AND {c} IS NOT NULL" for c in WX_COLUMNS
)


@query("level_feature_pairs", f"{with_(MERGED)} {_SCATTER}")
def level_feature_pairs(spark, sf_dir):
    return pairs_of(panels.merged(spark, sf_dir), K, "t", "level", WX_COLUMNS)


@query("recent_window", f"{with_(OBS)} SELECT station, t, level FROM obs o WHERE t >= (SELECT MAX(t) - 220 FROM obs p WHERE p.station = o.station)")
def recent_window(spark, sf_dir):
    return recent(panels.obs(spark, sf_dir), K, "t")


@query("split_overlap", """SELECT COUNT(*) AS n_overlap FROM (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_orderpriority, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus <> 'F')""")
def split_overlap(spark, sf_dir):
    rows = panels.readings(spark, sf_dir)
    return joins.overlap_count(rows.where("status = 'F'"), rows.where("status <> 'F'"), ["station", "t"])


@query("aligned_months", f"""WITH {SPLI}, r AS (SELECT o_orderpriority AS station, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS rain FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT s.station, s.month, {q6('s.z')} AS z, r.rain FROM spli s JOIN r ON r.station = s.station AND r.month = s.month WHERE s.z IS NOT NULL""")
def aligned_months(spark, sf_dir):
    rain = cal.monthly_aggregate(panels.wx(spark, sf_dir), K, "t", {"precip": "sum"}).withColumnRenamed("precip", "rain")
    out = joins.align(level_index(spark, sf_dir), rain, ["station", "month"], "z", "rain")
    return out.withColumn("z", r6("z"))


@query("season_profile_month_week", f"""{with_(OBS)}
SELECT station, 'month' AS by, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS period, {q6('AVG(level)', 4)} AS mean FROM obs GROUP BY ALL
UNION ALL SELECT station, 'week', CAST(year(t) AS INTEGER), CAST(weekofyear(t) AS INTEGER), {q6('AVG(level)', 4)} FROM obs GROUP BY ALL""")
def season_profile_month_week(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir))
    parts = [
        decompose.season_profile(daily, K, "t", "level", by).withColumn("by", F.lit(by)) for by in ("month", "week")
    ]
    return parts[0].unionByName(parts[1]).withColumn("mean", r6("mean", 4))


_CLIM = f"""{OBS}, cm AS (SELECT station, CAST(month(t) AS INTEGER) AS moy, AVG(level) AS m FROM obs GROUP BY ALL),
clim AS (SELECT a.station, a.moy, a.m - (SELECT AVG(b.m) FROM cm b WHERE b.station = a.station) AS seasonal FROM cm a)"""


@query("seasonal_climatology", f"WITH {_CLIM} SELECT station, moy, {q6('seasonal', 4)} AS seasonal FROM clim")
def seasonal_climatology(spark, sf_dir):
    rows = decompose.climatology(panels.obs(spark, sf_dir), K, "t", "level")
    return rows.withColumn("seasonal", r6("seasonal", 4))


@query("seasonal_lookup", f"WITH {_CLIM} SELECT o.station, o.t, {q6('c.seasonal', 4)} AS seasonal FROM obs o LEFT JOIN clim c ON c.station = o.station AND c.moy = month(o.t)")
def seasonal_lookup(spark, sf_dir):
    daily = reuse(panels.obs(spark, sf_dir))
    rows = joins.map_seasonal(daily.select("station", "t"), decompose.climatology(daily, K, "t", "level"), K, "t")
    return rows.withColumn("seasonal", r6("seasonal", 4))


@query("classical_decomposition", f"""WITH {INTERPOLATED},
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) AS rn, COUNT(*) OVER (PARTITION BY station) AS c FROM dense),
tr AS (SELECT station, t, y, CASE WHEN rn > 182 AND rn <= c - 182 THEN AVG(y) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) END AS trend FROM n),
m AS (SELECT station, month(t) AS moy, AVG(y - trend) AS m FROM tr GROUP BY 1, 2),
s AS (SELECT a.station, a.moy, a.m - (SELECT AVG(b.m) FROM m b WHERE b.station = a.station) AS seasonal FROM m a)
SELECT tr.station, tr.t, {q6('y', 3)} AS y, {q6('trend', 3)} AS trend, {q6('seasonal', 3)} AS seasonal, {q6('y - trend - seasonal', 3)} AS resid
FROM tr JOIN s ON s.station = tr.station AND s.moy = month(tr.t)""")
def classical_decomposition(spark, sf_dir):
    rows = decompose.decompose_classical(dense_levels(spark, sf_dir), K, "t", "level")
    return rows.select("station", "t", *[r6(c, 3).alias(c) for c in ("y", "trend", "seasonal", "resid")])


def _robust_pass(src: str, out: str, period: int) -> str:
    half = period // 2
    w = f"(PARTITION BY station ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""{out}_t AS (SELECT station, t, y, pos, weight,
   COALESCE(SUM((y - seasonal) * weight) OVER {w} / nullif(SUM(weight) OVER {w}, 0), AVG(y - seasonal) OVER {w}) AS trend FROM {src}),
{out}_p AS (SELECT station, pos, COALESCE(median(y - trend) FILTER (weight > 0), 0) AS s, COUNT(*) AS c FROM {out}_t GROUP BY 1, 2),
{out}_c AS (SELECT station, SUM(s * c) / SUM(c) AS mean_s FROM {out}_p GROUP BY 1),
{out}_r AS (SELECT a.*, p.s - c.mean_s AS seasonal, y - trend - (p.s - c.mean_s) AS resid
   FROM {out}_t a JOIN {out}_p p ON p.station = a.station AND p.pos = a.pos JOIN {out}_c c ON c.station = a.station),
{out}_h AS (SELECT station, 6 * median(abs(resid)) AS h FROM {out}_r GROUP BY 1),
{out} AS (SELECT r.station, r.t, r.y, r.pos, r.trend, r.seasonal, r.resid,
   CASE WHEN h.h = 0 OR abs(r.resid / h.h) < 1 THEN pow(1 - COALESCE(pow(r.resid / nullif(h.h, 0), 2), 0), 2) ELSE 0 END AS weight
   FROM {out}_r r JOIN {out}_h h ON h.station = r.station)"""


def robust_sql(period: int) -> str:
    return f"""{INTERPOLATED}, start_ AS (SELECT station, t, y, CAST((ROW_NUMBER() OVER (PARTITION BY station ORDER BY t) - 1) % {period} AS INTEGER) AS pos,
  CAST(0 AS DOUBLE) AS seasonal, CAST(1 AS DOUBLE) AS weight FROM dense), {_robust_pass('start_', 'pass1', period)}, {_robust_pass('pass1', 'pass2', period)}"""


@query("robust_decomposition", f"""WITH {robust_sql(365)} SELECT station, t, pos, {q6('trend', 3)} AS trend, {q6('seasonal', 3)} AS seasonal, {q6('resid', 3)} AS resid FROM pass2""")
def robust_decomposition(spark, sf_dir):
    rows = decompose.decompose_robust(dense_levels(spark, sf_dir), K, "t", "level", 365)
    return rows.select("station", "t", "pos", *[r6(c, 3).alias(c) for c in ("trend", "seasonal", "resid")])
