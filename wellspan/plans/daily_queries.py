"""Queries on loading, cleaning, joining and filling daily series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wellspan import schemas
from wellspan.functions.text import join_list_text, safe_name
from wellspan.operators import calendar as cal, clean, joins, rolling
from wellspan.plans.registry import MERGED, OBS, WX, calendar, months, q6, query, r6, with_
from wellspan.session import scratch_path
from wellspan.sources import chunks, feeds, panels, zones

K = ["station"]
WEATHER_SOURCE = {
    "temperature_2m_max": "tmax", "precipitation_sum": "precip", "shortwave_radiation_sum": "radiation",
    "et0_fao_evapotranspiration": "et0", "cloud_cover_mean": "cloud", "pressure_msl_mean": "pressure",
    "wind_speed_10m_mean": "wind", "soil_moisture_0_to_100cm_mean": "soil_moist",
    "soil_temperature_0_to_100cm_mean": "soil_temp",
}
_SQL_KINDS = {"double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR", "bigint": "BIGINT"}


def _weather_sql(names) -> str:
    """The variables of the panel, NULL for those it lacks."""
    return ", ".join(f"{WEATHER_SOURCE[v]} AS {v}" if v in WEATHER_SOURCE else f"CAST(NULL AS {_SQL_KINDS[schemas.WEATHER_VARIABLES[v]]}) AS {v}" for v in names)


_KEPT_WEATHER = [v for v in schemas.WEATHER_VARIABLES if v not in (*schemas.WEATHER_DROP_SPARSE, *schemas.WEATHER_DROP_COLLINEAR)]


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of the observation feed."""
    empty = lambda name: F.lit(None).cast("string").alias(name)
    return panels.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("code_bss"),
        F.col("o_orderkey").cast("string").alias("bss_id"),
        F.to_date("o_orderdate").alias("date_mesure"),
        F.col("o_totalprice").alias("niveau_nappe_eau"),
        (-F.col("o_totalprice")).alias("profondeur_nappe"),
        F.col("o_orderstatus").alias("mode_obtention"),
        F.lit("producer").alias("nom_producteur"),
        empty("urn_bss"),
        F.col("o_orderkey").alias("timestamp_mesure"),
        F.col("o_orderstatus").alias("statut"),
        *[empty(c) for c in (
            "qualification", "code_continuite", "nom_continuite", "code_producteur",
            "code_nature_mesure", "nom_nature_mesure",
        )],
    )


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather panel in the shape of the weather feed, all variables present."""
    wx = panels.wx(spark, sf_dir)
    columns = [
        (F.col(WEATHER_SOURCE[v]) if v in WEATHER_SOURCE else F.lit(None)).cast(kind).alias(v)
        for v, kind in schemas.WEATHER_VARIABLES.items()
    ]
    return wx.select(
        F.col("t").alias("date"), F.lit(45.0).alias("latitude"), F.lit(5.0).alias("longitude"),
        F.col("station").alias("code_bss"), *columns,
    )


@query("obs_clean_daily", f"""
SELECT o_orderpriority AS code_bss, CAST(o_orderdate AS DATE) AS date_index,
       {q6('AVG(o_totalprice)')} AS niveau_nappe_eau
FROM orders GROUP BY 1, 2""")
def obs_clean_daily(spark, sf_dir):
    cleaned = clean.clean_obs(raw_observations(spark, sf_dir))
    daily = clean.daily_mean(cleaned, ["code_bss"], "date_index", ["niveau_nappe_eau"])
    return daily.withColumn("niveau_nappe_eau", r6("niveau_nappe_eau"))


@query("weather_clean_daily", f"""
{with_(WX)} SELECT station AS code_bss, t AS date_index, {_weather_sql(_KEPT_WEATHER).replace('AS INTEGER', 'AS DOUBLE')} FROM wx""")
def weather_clean_daily(spark, sf_dir):
    cleaned = clean.clean_weather(raw_weather(spark, sf_dir))
    return clean.daily_mean(cleaned, ["code_bss"], "date_index", _KEPT_WEATHER)


@query("weather_left_join_obs", f"""
{with_(OBS, WX)} SELECT wx.*,
  (SELECT o.level FROM obs o WHERE o.station = wx.station AND o.t = wx.t) AS level FROM wx""")
def weather_left_join_obs(spark, sf_dir):
    return joins.merge_obs(panels.wx(spark, sf_dir), panels.obs(spark, sf_dir), ["station", "t"])


@query("join_audit", f"""
{with_(OBS, WX)} SELECT (SELECT COUNT(*) FROM wx) AS n_rows,
  (SELECT COUNT(*) FROM wx WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.station = wx.station AND o.t = wx.t)) AS n_unmatched""")
def join_audit(spark, sf_dir):
    merged = joins.merge_obs(panels.wx(spark, sf_dir), panels.obs(spark, sf_dir), ["station", "t"])
    return joins.audit_join(merged, "level")


@query("obs_inner_weather", f"""
{with_(OBS, WX)} SELECT o.level, w.* FROM obs o, wx w WHERE o.station = w.station AND o.t = w.t""")
def obs_inner_weather(spark, sf_dir):
    return joins.merge_obs(panels.wx(spark, sf_dir), panels.obs(spark, sf_dir), ["station", "t"], "inner")


@query("last_dates_resume", """
SELECT c_custkey AS station, d.last_date,
       CASE WHEN d.last_date IS NULL THEN DATE '1995-01-01' ELSE CAST(d.last_date + INTERVAL 1 DAY AS DATE) END AS start_date
FROM customer LEFT JOIN (
  SELECT o_custkey, MAX(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1) d ON d.o_custkey = c_custkey""")
def last_dates_resume(spark, sf_dir):
    stations = panels.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"))
    history = panels.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("t")
    )
    last = chunks.last_dates(history, K, "t")
    return chunks.resume_dates(stations, last, K, F.lit(dt.date(1995, 1, 1)))


@query("chunk_plan", """
WITH s AS (SELECT o_custkey AS station, MIN(CAST(o_orderdate AS DATE)) AS a, MAX(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
y AS (SELECT CAST(range AS INTEGER) AS year FROM range(1990, 2010))
SELECT station, year,
       CASE WHEN year(a) = year THEN a ELSE make_date(year, 1, 1) END AS chunk_start,
       CASE WHEN year(b) = year THEN b ELSE make_date(year, 12, 31) END AS chunk_end
FROM s JOIN y ON y.year BETWEEN year(a) AND year(b)""")
def chunk_plan(spark, sf_dir):
    periods = panels.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("station")).agg(
        F.min(F.to_date("o_orderdate")).alias("start"), F.max(F.to_date("o_orderdate")).alias("end")
    )
    return chunks.plan_chunks(periods, K, "start", "end")


@query("chunk_plan_missing", """
WITH s AS (SELECT o_custkey AS station, MIN(year(o_orderdate)) AS a, MAX(year(o_orderdate)) AS b FROM orders GROUP BY 1),
p AS (SELECT station, CAST(UNNEST(generate_series(a, b)) AS INTEGER) AS year FROM s)
SELECT station, year FROM p
EXCEPT SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) FROM orders""")
def chunk_plan_missing(spark, sf_dir):
    landed = panels.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("year")
    )
    return chunks.missing_chunks(chunk_plan(spark, sf_dir), landed, K).select("station", "year")


@query("history_upsert_last", """
SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq, o_totalprice AS level, o_orderstatus AS status
FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE)
  ORDER BY o_orderstatus = 'O' DESC, o_orderkey DESC) = 1""")
def history_upsert_last(spark, sf_dir):
    """Two raw deliveries with several rows a day: open orders are the newer one."""
    rows = panels.readings(spark, sf_dir)
    return clean.upsert_last(rows.where("status <> 'O'"), rows.where("status = 'O'"), ["station", "t"], ["seq"])


@query("dedupe_first_reading", """
SELECT station, t, seq, level, status FROM (
  SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq, o_totalprice AS level, o_orderstatus AS status,
         ROW_NUMBER() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def dedupe_first_reading(spark, sf_dir):
    return clean.dedupe_first(panels.readings(spark, sf_dir), ["station", "t"], ["seq"])


@query("dedupe_last_reading", """
SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq, o_totalprice AS level, o_orderstatus AS status
FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM orders p WHERE p.o_orderpriority = o.o_orderpriority
  AND CAST(p.o_orderdate AS DATE) = CAST(o.o_orderdate AS DATE) AND p.o_orderkey > o.o_orderkey)""")
def dedupe_last_reading(spark, sf_dir):
    return clean.dedupe_last(panels.readings(spark, sf_dir), ["station", "t"], ["seq"])


@query("missing_dates", f"""
{with_(OBS, calendar('obs'))} SELECT station, t FROM cal c
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.station = c.station AND o.t = c.t)""")
def missing_dates(spark, sf_dir):
    return cal.missing_dates(panels.readings(spark, sf_dir), K, "t")


@query("calendar_set_difference", f"""
{with_(OBS, calendar('obs'))} SELECT station, t FROM cal EXCEPT SELECT station, t FROM obs""")
def calendar_set_difference(spark, sf_dir):
    return cal.calendar_difference(panels.readings(spark, sf_dir), K, "t")


@query("dense_calendar", f"""
{with_(OBS, calendar('obs', extra=14))} SELECT c.station, c.t, o.level FROM cal c
LEFT JOIN obs o ON o.station = c.station AND o.t = c.t""")
def dense_calendar(spark, sf_dir):
    return cal.densify(panels.obs(spark, sf_dir), K, "t", extra=14)


_NEIGHBOURS = """near AS (
  SELECT c.station, c.t, o.level,
    (SELECT MAX(p.t) FROM {known} p WHERE p.station = c.station AND p.t <= c.t) AS t0,
    (SELECT MIN(p.t) FROM {known} p WHERE p.station = c.station AND p.t >= c.t) AS t1
  FROM {src} c LEFT JOIN {known} o ON o.station = c.station AND o.t = c.t)"""
_LINE = f"""SELECT n.station, n.t, {q6('''CASE WHEN n.t0 IS NULL THEN NULL WHEN n.t1 IS NULL OR n.t0 = n.t1 THEN a.level
    ELSE (b.level - a.level) / (n.t1 - n.t0) * (n.t - n.t0) + a.level END''')} AS level
FROM near n LEFT JOIN obs a ON a.station = n.station AND a.t = n.t0 LEFT JOIN obs b ON b.station = n.station AND b.t = n.t1"""


@query("interpolated_daily", f"{with_(OBS, calendar('obs'), _NEIGHBOURS.format(src='cal', known='obs'))} {_LINE}")
def interpolated_daily(spark, sf_dir):
    dense = cal.densify(panels.obs(spark, sf_dir), K, "t")
    return clean.interpolate_linear(dense, K, "t", ["level"]).withColumn("level", r6("level"))


@query("conformed_daily", f"{with_(MERGED, 'known AS (SELECT station, t, level FROM merged WHERE level IS NOT NULL)', _NEIGHBOURS.format(src='merged', known='known'))} {_LINE}")
def conformed_daily(spark, sf_dir):
    rows = clean.conform_daily(panels.merged(spark, sf_dir), K, "t", ["level"])
    return rows.select("station", "t", r6("level").alias("level"))


# the first reading of a day by delivery; readings of status P have no level
FIRST_READING = """(SELECT * EXCLUDE (rn) FROM (
  SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS level,
         ROW_NUMBER() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
  FROM orders) WHERE rn = 1)"""


def gappy_readings(spark, sf_dir):
    """Raw readings, several a day, some without a level."""
    return panels.readings(spark, sf_dir).withColumn("level", F.when(F.col("status") != "P", F.col("level"))).drop("status")


@query("conformed_raw_readings", f"{with_(f'readings AS {FIRST_READING}', 'known AS (SELECT station, t, level FROM readings WHERE level IS NOT NULL)', _NEIGHBOURS.format(src='readings', known='known'))} {_LINE.replace('JOIN obs ', 'JOIN known ')}")
def conformed_raw_readings(spark, sf_dir):
    rows = clean.conform_daily(gappy_readings(spark, sf_dir), K, "t", ["level"], order=["seq"])
    return rows.select("station", "t", r6("level").alias("level"))


@query("forward_filled_daily", f"""
{with_(MERGED)} SELECT m.station, m.t, {q6('''(SELECT o.level FROM merged o WHERE o.station = m.station AND o.t <= m.t
   AND o.level IS NOT NULL ORDER BY o.t DESC LIMIT 1)''')} AS level FROM merged m""")
def forward_filled_daily(spark, sf_dir):
    rows = clean.forward_fill(panels.merged(spark, sf_dir).select("station", "t", "level"), K, "t", ["level"])
    return rows.withColumn("level", r6("level"))


def _rolled(column: str, n: int, how: str) -> str:
    w = f"(PARTITION BY station ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({column}) OVER {w} = {n} THEN {how}({column}) OVER {w} END"


def _filled(column: str) -> str:
    first = f"(SELECT f.{column} FROM rolled f WHERE f.station = r.station AND f.{column} IS NOT NULL ORDER BY f.t LIMIT 1)"
    return f"COALESCE(r.{column}, {first})"


@query("rolling_precip_7_30_90", f"""
{with_(WX, f'''rolled AS (SELECT station, t, {_rolled('precip', 7, 'SUM')} AS p7,
  {_rolled('precip', 30, 'SUM')} AS p30, {_rolled('precip', 90, 'SUM')} AS p90 FROM wx)''')}
SELECT station, t, {q6('p7')} AS p7, {q6('p30')} AS p30, {q6('p90')} AS p90 FROM rolled""")
def rolling_precip_7_30_90(spark, sf_dir):
    rows = rolling.rolling_sums(panels.wx(spark, sf_dir), K, "t", {"p": F.col("precip")}, (7, 30, 90))
    return rows.select("station", "t", *[r6(f"p_{n}").alias(f"p{n}") for n in (7, 30, 90)])


_WB = f"""rolled AS (SELECT station, t,
  {_rolled('precip', 30, 'SUM')} AS p30, {_rolled('precip', 90, 'SUM')} AS p90,
  {_rolled('peff', 30, 'SUM')} AS e30, {_rolled('peff', 90, 'SUM')} AS e90,
  round_even({_rolled('tmax', 30, 'AVG')}, 2) AS t30, round_even({_rolled('tmax', 90, 'AVG')}, 2) AS t90
  FROM (SELECT *, precip - et0 AS peff FROM wx))"""


@query("water_balance_features", f"""
{with_(WX, _WB)} SELECT station, t, {q6(_filled('p30'), 4)} AS P_cum_30d, {q6(_filled('p90'), 4)} AS P_cum_90d,
  {q6(_filled('e30'), 4)} AS Peff_cum_30d, {q6(_filled('e90'), 4)} AS Peff_cum_90d,
  {q6(_filled('t30'))} AS Temperature_mean_30d, {q6(_filled('t90'))} AS Temperature_mean_90d FROM rolled r""")
def water_balance_features(spark, sf_dir):
    # whole-number temperatures, so that means on a rounding edge are equal in every engine
    df = rolling.water_balance_features(panels.wx(spark, sf_dir), K, "t", "precip", "et0", "tmax")
    sums = ["P_cum_30d", "P_cum_90d", "Peff_cum_30d", "Peff_cum_90d"]
    return df.select(
        "station", "t", *[r6(c, 4).alias(c) for c in sums], "Temperature_mean_30d", "Temperature_mean_90d"
    )


@query("centered_ma_7_365", f"""
{with_(WX, 'wr AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY t) AS rn, COUNT(*) OVER (PARTITION BY station) AS n FROM wx)')}
SELECT station, t,
  {q6('CASE WHEN rn > 3 AND rn <= n - 3 THEN AVG(soil_temp) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END')} AS ma_7,
  {q6('CASE WHEN rn > 182 AND rn <= n - 182 THEN AVG(soil_temp) OVER (PARTITION BY station ORDER BY t ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) END')} AS ma_365
FROM wr""")
def centered_ma_7_365(spark, sf_dir):
    w = Window.partitionBy("station").orderBy("t")
    rows = panels.wx(spark, sf_dir).select("station", "t", "soil_temp")
    rows = rows.withColumn("ma_7", rolling.rolling_centered(F.col("soil_temp"), 7, w))
    rows = rolling.with_centered_mean(rows, K, "t", "soil_temp", 365, "ma_365")
    return rows.select("station", "t", r6("ma_7").alias("ma_7"), r6("ma_365").alias("ma_365"))


@query("monthly_resample_mean_sum_last", f"""
{with_(MERGED, months('merged'))}
SELECT s.station, s.month, {q6('AVG(m.level)')} AS level, {q6('COALESCE(SUM(m.precip), 0)')} AS precip,
  {q6('arg_max(m.soil_temp, m.t)')} AS soil_temp
FROM cal_m s LEFT JOIN merged m ON m.station = s.station AND CAST(date_trunc('month', m.t) AS DATE) = s.month GROUP BY 1, 2""")
def monthly_resample(spark, sf_dir):
    how = {"level": "mean", "precip": "sum", "soil_temp": "last"}
    rows = cal.monthly(panels.merged(spark, sf_dir), K, "t", how)
    return rows.select("station", "month", *[r6(c).alias(c) for c in how])


@query("supplier_months_dense", """
WITH d AS (SELECT l_suppkey AS station, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
             SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1, 2),
s AS (SELECT station, CAST(UNNEST(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
      FROM (SELECT station, MIN(month) AS a, MAX(month) AS b FROM d GROUP BY 1))
SELECT s.station, s.month, CAST(COALESCE(d.q, 0) AS DOUBLE) AS quantity FROM s LEFT JOIN d ON d.station = s.station AND d.month = s.month""")
def supplier_months_dense(spark, sf_dir):
    lines = panels.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.to_date("l_shipdate").alias("t"), F.col("l_quantity").alias("quantity")
    )
    return cal.monthly(lines, K, "t", {"quantity": "sum"})


@query("gap_stats", f"""
{with_(OBS)} SELECT station, MIN(g) AS min_gap, MAX(g) AS max_gap FROM (
  SELECT station, CAST(t - LAG(t) OVER (PARTITION BY station ORDER BY t) AS INTEGER) AS g FROM obs) GROUP BY 1""")
def gap_stats(spark, sf_dir):
    return cal.gap_stats(panels.obs(spark, sf_dir), K, "t")


@query("latest_preview", """
SELECT strftime(t, '%Y-%m-%d') AS date, seq, level FROM (
  SELECT CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq, o_totalprice AS level FROM orders
  ORDER BY 1 DESC, level, seq LIMIT 50)""")
def latest_preview(spark, sf_dir):
    rows = panels.readings(spark, sf_dir).select(F.col("t").alias("date"), "seq", "level")
    return zones.preview(rows, "date", 50)


@query("station_list_text", """
SELECT code_bss, string_agg(s, ', ' ORDER BY s) AS statuses, replace(code_bss, '/', '') AS file_stem FROM (
  SELECT DISTINCT o_orderpriority || '/' || CAST(year(o_orderdate) AS VARCHAR) AS code_bss, o_orderstatus AS s FROM orders) GROUP BY 1""")
def station_list_text(spark, sf_dir):
    code = F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("code_bss")
    listed = panels.table(spark, sf_dir, "orders").groupBy(code).agg(
        F.array_sort(F.collect_set("o_orderstatus")).alias("s")
    )
    text = F.concat(F.lit("['"), F.array_join("s", "', '"), F.lit("']"))
    return listed.select(
        "code_bss", join_list_text(text).alias("statuses"), safe_name(F.col("code_bss")).alias("file_stem")
    )


# --- sources and sinks: files written from the tables, then read back ---------------------

@query("observation_pages", """
SELECT o_orderpriority AS code_bss, CAST(o_orderkey AS VARCHAR) AS bss_id, CAST(o_orderdate AS DATE) AS date_mesure,
       o_totalprice AS niveau_nappe_eau, o_orderstatus AS statut FROM orders""")
def observation_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    observation_documents(spark, sf_dir).select("value").write.text(path)
    return feeds.read_obs_pages(spark, path).select("code_bss", "bss_id", "date_mesure", "niveau_nappe_eau", "statut")


def observation_documents(spark, sf_dir):
    """Pages of up to 500 readings, as the observation feed lands them."""
    rows = raw_observations(spark, sf_dir)
    page = F.floor(F.col("timestamp_mesure") / 500)
    names = [f.name for f in schemas.OBSERVATION_SCHEMA]
    pages = rows.groupBy("code_bss", page.alias("page")).agg(F.collect_list(F.struct(*names)).alias("data"))
    following = F.lead("page").over(_by_station("code_bss", "page"))
    envelope = F.struct("data", F.concat(F.lit("page="), following.cast("string")).alias("next"))
    return pages.select("page", F.to_json(envelope).alias("value"))


def _by_station(key, order):
    return Window.partitionBy(key).orderBy(order)


@query("weather_documents", f"""
{with_(WX)} SELECT station AS code_bss, t AS date, 45.0::DOUBLE AS latitude, 5.0::DOUBLE AS longitude, {_weather_sql(schemas.WEATHER_VARIABLES)} FROM wx""")
def weather_documents(spark, sf_dir):
    path = scratch_path(spark, "weather")
    weather_document_rows(spark, sf_dir).select("value").write.text(path)
    return feeds.read_weather_docs(spark, path)


def weather_document_rows(spark, sf_dir):
    """One document per station and year with parallel arrays, as the weather feed lands them."""
    wx = raw_weather(spark, sf_dir)
    names = list(schemas.WEATHER_VARIABLES)
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("time"), *names)
    docs = wx.groupBy("code_bss", "latitude", "longitude", F.year("date").alias("year")).agg(
        F.array_sort(F.collect_list(day)).alias("days")
    )
    daily = F.struct(*[F.col(f"days.{c}").alias(c) for c in ["time", *names]])
    return docs.select(
        "year", F.to_json(F.struct("code_bss", "latitude", "longitude", daily.alias("daily")), {"ignoreNullFields": "false"}).alias("value"))


@query("station_master", """
SELECT CAST(c_custkey AS VARCHAR) AS code_bss, c_acctbal AS longitude, CAST(c_nationkey AS DOUBLE) AS latitude, c_name AS libelle_pe
FROM customer""")
def station_master(spark, sf_dir):
    customers = panels.table(spark, sf_dir, "customer")
    record = F.struct(
        F.col("c_custkey").cast("string").alias("code_bss"), F.col("c_name").alias("libelle_pe"),
        F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"),
    )
    pages = customers.groupBy(F.floor(F.col("c_custkey") / 200)).agg(F.collect_list(record).alias("data"))
    path = scratch_path(spark, "stations")
    pages.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    return feeds.read_stations(spark, path).select("code_bss", "longitude", "latitude", "libelle_pe")


@query("zone_csv_roundtrip", f"{with_(MERGED)} SELECT station, t, precip, level FROM merged")
def zone_csv_roundtrip(spark, sf_dir):
    rows = panels.merged(spark, sf_dir).select("station", "t", "precip", "level")
    path = zones.write_zone(rows, scratch_path(spark, "zone-csv"), fmt="csv")
    return zones.read_zone(spark, path, schemas.struct_of({"station": "string", "t": "date", "precip": "double", "level": "double"}), "csv")


@query("zone_csv_nan", f"{with_(OBS)} SELECT station, COUNT(*) AS n, COUNT(level) AS n_level, {q6('AVG(level)')} AS mean_level FROM (SELECT station, CASE WHEN day(t) > 3 THEN level END AS level FROM obs) GROUP BY 1")
def zone_csv_nan(spark, sf_dir):
    """Readings of the first days of a month land as the text NaN, which is read as missing."""
    rows = panels.obs(spark, sf_dir).withColumn("level", F.when(F.dayofmonth("t") > 3, F.col("level")).otherwise(F.lit(float("nan"))))
    path = zones.write_zone(rows, scratch_path(spark, "zone-nan"), fmt="csv")
    back = zones.read_zone(spark, path, schemas.struct_of({"station": "string", "t": "date", "level": "double"}), "csv")
    return back.groupBy("station").agg(F.count("*").alias("n"), F.count("level").alias("n_level"), r6(F.avg("level")).alias("mean_level"))


@query("zone_parquet_by_year", f"{with_(OBS)} SELECT station, t, level, CAST(year(t) AS INTEGER) AS year FROM obs WHERE year(t) >= 1999")
def zone_parquet_by_year(spark, sf_dir):
    rows = panels.obs(spark, sf_dir).withColumn("year", F.year("t"))
    path = zones.write_zone(rows, scratch_path(spark, "zone"), ["year"])
    return zones.read_zone(spark, path).where("year >= 1999")


@query("snapshot_roundtrip", f"""{with_(OBS, WX)} SELECT station, t, level, CAST(NULL AS DOUBLE) AS precip, DATE '2024-05-06' AS snapshot_date, 'levels' AS name FROM obs
UNION ALL SELECT station, t, NULL, precip, DATE '2024-05-06', 'weather' FROM wx""")
def snapshot_roundtrip(spark, sf_dir):
    """Both history tables written as dated snapshots and loaded again."""
    prefix, day = scratch_path(spark, "snap"), dt.date(2024, 5, 6)
    tables = {"levels": panels.obs(spark, sf_dir), "weather": panels.wx(spark, sf_dir).select("station", "t", "precip")}
    paths = [zones.write_snapshot(df, prefix, name, day) for name, df in tables.items()]
    loaded = zones.load_history(spark, *paths)
    return feeds.union_frames(*[df.withColumn("name", F.lit(name)) for name, df in zip(tables, loaded)])


@query("stations_union", """
SELECT 'order' AS feed, o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_totalprice AS level, CAST(NULL AS DOUBLE) AS tmax FROM orders
UNION ALL
SELECT 'line', CAST(l_suppkey AS VARCHAR), CAST(l_shipdate AS DATE), NULL, l_quantity FROM lineitem""")
def stations_union(spark, sf_dir):
    a = panels.readings(spark, sf_dir).select(F.lit("order").alias("feed"), "station", "t", "level")
    b = panels.table(spark, sf_dir, "lineitem").select(
        F.lit("line").alias("feed"), F.col("l_suppkey").cast("string").alias("station"),
        F.to_date("l_shipdate").alias("t"), F.col("l_quantity").alias("tmax"),
    )
    return feeds.union_frames(a, b)


@query("station_subset_period", """
SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t, o_orderkey AS seq FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1999-03-01' AND o_orderdate < TIMESTAMP '2000-04-01'""")
def station_subset_period(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "orders")
    rows = feeds.only_stations(rows, ["1-URGENT", "2-HIGH"], "o_orderpriority")
    rows = rows.where((F.col("o_orderdate") >= F.lit("1999-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("2000-04-01").cast("timestamp_ntz")))
    return rows.select(
        F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("t"), F.col("o_orderkey").alias("seq")
    )
