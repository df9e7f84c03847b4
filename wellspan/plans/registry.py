"""Registry of named queries, each with the SQL that states the same result independently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wellspan.functions import normal

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked by the tests."""

    def add(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, fn, sql)
        return fn

    return add


NUDGE = 0.017  # of the last kept digit


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison across engines, whose sums differ in the last bits.

    A nudge far above that noise moves exact ties off the rounding edge.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double") + F.lit(NUDGE * 10.0**-places), places)


# --- SQL fragments -----------------------------------------------------------------------

def q6(expression: str, places: int = 6) -> str:
    """SQL counterpart of :func:`r6`; adding zero turns -0.0 into 0.0."""
    nudge = NUDGE * 10.0**-places
    return f"(round(CAST({expression} AS DOUBLE) + CAST({nudge!r} AS DOUBLE), {places}) + 0.0)"


OBS = """obs AS (
  SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS t,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS level
  FROM orders GROUP BY 1, 2)"""

WX = """wx AS (
  SELECT o_orderpriority AS station, CAST(l_shipdate AS DATE) AS t,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS precip,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS et0,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS soil_temp,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS soil_moist,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS radiation,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS wind,
         CAST(SUM(l_linenumber) AS DOUBLE) / COUNT(*) AS cloud,
         CAST(SUM(l_partkey % 1000) AS DOUBLE) / COUNT(*) AS pressure,
         MAX(l_quantity) AS tmax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

MERGED = f"""{OBS}, {WX}, merged AS (
  SELECT wx.*, obs.level FROM wx LEFT JOIN obs ON wx.station = obs.station AND wx.t = obs.t)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def calendar(src: str, out: str = "cal", extra: int = 0, keys: str = "station") -> str:
    """Day spine by generated series."""
    return f"""{out} AS (
  SELECT {keys}, CAST(UNNEST(generate_series(CAST(a AS TIMESTAMP), CAST(b + {extra} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS t
  FROM (SELECT {keys}, MIN(t) AS a, MAX(t) AS b FROM {src} GROUP BY {keys}))"""


def months(src: str, out: str = "cal_m", extra: int = 0, keys: str = "station") -> str:
    """Month spine by generated series."""
    return f"""{out} AS (
  SELECT {keys}, CAST(UNNEST(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL {extra} MONTH, INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT {keys}, date_trunc('month', MIN(t)) AS a, date_trunc('month', MAX(t)) AS b FROM {src} GROUP BY {keys}))"""


def _horner(coefficients: list[float], x: str) -> str:
    text = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def ppf_sql(src: str, out: str, p: str = "p", z: str = "z") -> str:
    """CTEs that add the normal quantile ``z`` of column ``p``."""
    return f"""{out}_q AS (SELECT *, {p} - CAST(0.5 AS DOUBLE) AS q_,
    sqrt(-ln(least({p}, 1 - {p}))) AS tail_ FROM {src}),
{out}_r AS (SELECT *, CAST(0.180625 AS DOUBLE) - q_ * q_ AS r_, tail_ - 1.6 AS near_, tail_ - 5.0 AS far_ FROM {out}_q),
{out} AS (SELECT * EXCLUDE (q_, tail_, r_, near_, far_),
    CASE WHEN abs(q_) <= 0.425 THEN q_ * {_horner(normal.CENTRAL_NUM, 'r_')} / {_horner(normal.CENTRAL_DEN, 'r_')}
         WHEN tail_ <= 5 THEN sign(q_) * {_horner(normal.NEAR_NUM, 'near_')} / {_horner(normal.NEAR_DEN, 'near_')}
         ELSE sign(q_) * {_horner(normal.FAR_NUM, 'far_')} / {_horner(normal.FAR_DEN, 'far_')} END AS {z}
  FROM {out}_r)"""


def score_sql(src: str, out: str, keys: str = "station", value: str = "value") -> str:
    """CTEs ranking ``value`` within calendar month by comparing pairs, then the normal quantile."""
    on = " AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"""{out}_p AS (
  SELECT a.*, CASE WHEN a.{value} IS NULL THEN NULL ELSE
    (c.less + (c.same + 1) / CAST(2 AS DOUBLE) - CAST(0.44 AS DOUBLE)) / (c.n + 1 - CAST(0.88 AS DOUBLE)) END AS p
  FROM {src} a LEFT JOIN (
    SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.month,
           COUNT(CASE WHEN round(b.{value}, 8) < round(a.{value}, 8) THEN 1 END) AS less,
           COUNT(CASE WHEN round(b.{value}, 8) = round(a.{value}, 8) THEN 1 END) AS same, COUNT(b.{value}) AS n
    FROM {src} a JOIN {src} b ON {on} AND month(b.month) = month(a.month) GROUP BY ALL) c
  ON {on.replace('b.', 'c.')} AND c.month = a.month),
{ppf_sql(f'{out}_p', out)}"""


MONTHLY_LEVEL = f"""{months('obs')}, monthly AS (
  SELECT s.station, s.month, AVG(level) AS value
  FROM cal_m s LEFT JOIN obs o ON o.station = s.station AND CAST(date_trunc('month', o.t) AS DATE) = s.month
  GROUP BY 1, 2)"""

SPLI = f"{OBS}, {MONTHLY_LEVEL}, {score_sql('monthly', 'spli')}"
