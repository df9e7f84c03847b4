"""The additive forecaster stated in SQL: design rows, Gram matrices by dot products, Gauss-Jordan by recursion."""

from __future__ import annotations

import math
import re

from wellspan.operators.models import FOURIER_ORDER, KNOTS, REGRESSOR_PRIOR, YEAR_DAYS, interval_z

_LOOSE = "list_transform(range(1, p + 1), lambda i: CASE WHEN keep[i] THEN 1e-9::DOUBLE ELSE 1::DOUBLE END)"


def _solve(src: str, out: str, weights: str) -> str:
    """CTEs that solve (gram + diag(weights)) b = right for every row of ``src`` (sys, p, gram, right, keep, n).

    Step k divides row k by its first value, subtracts multiples of it from the others and drops the first
    column, so that after p steps each row holds its part of the solution.
    """
    return f"""{out}_rec(sys, i, k, p, r) USING KEY (sys, i) AS (
  SELECT sys, i, 0, p, list_append(list_transform(gram[i], lambda v, j: v + CASE WHEN i = j THEN w[i] ELSE 0 END), "right"[i]) FROM (SELECT *, {weights} AS w, UNNEST(range(1, p + 1)) AS i FROM {src})
  UNION
  SELECT a.sys, a.i, a.k + 1, a.p, CASE WHEN a.i = a.k + 1 THEN b.u ELSE list_transform(list_zip(a.r[2:], b.u), lambda z: z[1] - z[2] * a.r[1]) END
  FROM {out}_rec a JOIN (SELECT sys, list_transform(r[2:], lambda v: v / r[1]) AS u FROM {out}_rec WHERE i = k + 1 AND k < p) b ON b.sys = a.sys),
{out} AS (SELECT s.*, r.beta FROM (SELECT sys, list(r[1] ORDER BY i) AS beta FROM {out}_rec GROUP BY 1) r JOIN {src} s USING (sys)),
{out}_rss AS (SELECT *, greatest(yy - 2 * list_dot_product(beta, "right") + list_dot_product(beta, list_transform(gram, lambda r: list_dot_product(r, beta))), 0) AS rss FROM {out})"""


_NAMES = ("ends", "knots", "timed", "design", "fold", "cells", "cols", "dots", "grams", "grid", "masked", "systems", "loose", "loose_rec", "loose_rss",
          "weighed", "solved", "solved_rec", "solved_rss", "fitted", "cv", "cvi", "scored")


def additive_sql(frame: str, cutoffs: str, regressors: list[str], configs: list[dict], h: str, width: float = 0.8, prefix: str = "") -> str:
    """The CTEs of :func:`_additive_sql`, their names with ``prefix``."""
    text = _additive_sql(frame, cutoffs, regressors, configs, h, width)
    return re.sub(rf"\b({'|'.join(_NAMES)})\b", rf"{prefix}\1", text) if prefix else text


def _additive_sql(frame: str, cutoffs: str, regressors: list[str], configs: list[dict], h: str, width: float) -> str:
    """CTEs from ``frame`` (station, ds, y, regressors) and ``cutoffs`` (station, cutoff) to ``cv``.

    ``h`` is an expression over ``c`` (a row of ``cutoffs``) for the days ahead. Beside ``cv``
    there is ``scored``, the predictions of all rows of ``frame``, those without a level included.
    """
    r = len(regressors)
    waves = ", ".join(f"{f}(a * {k})" for k in range(1, FOURIER_ORDER + 1) for f in ("sin", "cos"))
    raw = "[" + ", ".join(f"f.{c}" for c in regressors) + "]::DOUBLE[]"
    means = "[" + ", ".join(f"AVG(d.regs[{i + 1}])" for i in range(r)) + "]::DOUBLE[]"
    spreads = "[" + ", ".join(f"STDDEV_POP(d.regs[{i + 1}])" for i in range(r)) + "]::DOUBLE[]"
    grid = " UNION ALL ".join(
        f"SELECT {i} AS config_id, {c['changepoint_range']!r}::DOUBLE AS share, {c['changepoint_prior_scale']!r}::DOUBLE AS cps, {c['seasonality_prior_scale']!r}::DOUBLE AS sps"
        for i, c in enumerate(configs))
    prior = (f"CASE WHEN i = 1 THEN 5 WHEN i = 2 THEN 5 / reach WHEN i <= 2 + kn THEN cps / reach WHEN i <= {2 + 2 * FOURIER_ORDER} + kn THEN sps ELSE {REGRESSOR_PRIOR!r}::DOUBLE END")
    ridge = f"list_transform(range(1, p + 1), lambda i: CASE WHEN keep[i] THEN noise / pow({prior}, 2) ELSE 1::DOUBLE END)"
    standard = "list_concat(d.base, list_transform(d.regs, lambda v, i: CASE WHEN s.spread[i] > 0 THEN (v - s.mean[i]) / s.spread[i] ELSE 0 END))"
    return f"""ends AS (SELECT f.station, MIN(f.ds) AS first_, MIN(c.c1) AS c1, MIN(c.c2) AS c2 FROM {frame} f JOIN (SELECT station, MIN(cutoff) AS c1, MAX(cutoff) AS c2 FROM {cutoffs} GROUP BY 1) c ON c.station = f.station
  WHERE f.y IS NOT NULL GROUP BY 1),
knots AS (SELECT *, greatest(c1 - first_, 1) AS unit, greatest(CAST(ceil((c2 - first_) / CAST(greatest(c1 - first_, 1) AS DOUBLE) * {KNOTS + 1}) AS INTEGER) - 1, 0) AS kn FROM ends),
timed AS (SELECT f.station, f.ds, f.y, k.kn, k.first_, k.unit, {raw} AS regs, (f.ds - k.first_) / CAST(k.unit AS DOUBLE) AS t, (f.ds - DATE '1970-01-01') * {2 * math.pi / YEAR_DAYS!r}::DOUBLE AS a
  FROM {frame} f JOIN knots k ON k.station = f.station),
design AS MATERIALIZED (SELECT station, ds, y, kn, first_, unit, regs, list_concat([1, t]::DOUBLE[], list_transform(range(1, kn + 1), lambda j: greatest(t - j / {KNOTS + 1}::DOUBLE, 0)), [{waves}]::DOUBLE[]) AS base FROM timed),
fold AS MATERIALIZED (SELECT c.station, c.cutoff, ANY_VALUE({h}) AS h, COUNT(*) AS n, MAX(abs(d.y)) AS peak, {means} AS mean, {spreads} AS spread, MIN(d.kn) AS kn, greatest((c.cutoff - MIN(d.first_)) / CAST(MIN(d.unit) AS DOUBLE), 1e-9) AS reach
  FROM {cutoffs} c JOIN design d ON d.station = c.station AND d.ds <= c.cutoff AND d.y IS NOT NULL GROUP BY c.station, c.cutoff),
cells AS (SELECT s.station, s.cutoff, d.ds, UNNEST(list_append({standard}, d.y / s.peak)) AS v, generate_subscripts(list_append({standard}, d.y), 1) AS j
  FROM fold s JOIN design d ON d.station = s.station AND d.ds <= s.cutoff AND d.y IS NOT NULL),
cols AS MATERIALIZED (SELECT station, cutoff, j, list(v ORDER BY ds) AS v FROM cells GROUP BY 1, 2, 3),
dots AS (SELECT a.station, a.cutoff, a.j AS i, list(list_dot_product(a.v, b.v) ORDER BY b.j) AS g FROM cols a JOIN cols b ON b.station = a.station AND b.cutoff = a.cutoff GROUP BY 1, 2, 3),
grams AS MATERIALIZED (SELECT d.station, d.cutoff, MAX(i) - 1 AS p, list(g ORDER BY i) AS g FROM dots d GROUP BY 1, 2),
grid AS ({grid}),
masked AS (SELECT g.*, s.n, s.kn, s.reach, x.share, s.spread, list_transform(range(1, g.p + 1), lambda i: CASE WHEN i > 2 AND i <= 2 + s.kn THEN (i - 2) / {KNOTS + 1}::DOUBLE <= s.reach * x.share
     WHEN i > g.p - {r} THEN s.spread[i - (g.p - {r})] > 0 ELSE true END) AS keep
  FROM grams g JOIN fold s ON s.station = g.station AND s.cutoff = g.cutoff CROSS JOIN (SELECT DISTINCT share FROM grid) x),
systems AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY station, cutoff, share) AS sys, station, cutoff, share, p, n, kn, reach, keep, g[p + 1][p + 1] AS yy,
  list_transform(g[1:p], lambda r, i: list_transform(r[1:p], lambda v, j: CASE WHEN keep[i] AND keep[j] THEN v ELSE 0 END)) AS gram,
  list_transform(g[p + 1][1:p], lambda v, j: CASE WHEN keep[j] THEN v ELSE 0 END) AS "right" FROM masked),
{_solve('systems', 'loose', _LOOSE)},
weighed AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY l.sys, x.config_id) AS sys, x.config_id, x.cps, x.sps, greatest(l.rss / l.n, 1e-12) AS noise, l.* EXCLUDE (sys, beta, rss)
  FROM loose_rss l JOIN grid x ON x.share = l.share),
{_solve('weighed', 'solved', ridge)},
fitted AS MATERIALIZED (SELECT w.station, w.cutoff, w.config_id, w.beta, s.peak, s.mean, s.spread, s.n, s.h, s.peak * sqrt(w.rss / w.n) AS sigma FROM solved_rss w JOIN fold s ON s.station = w.station AND s.cutoff = w.cutoff),
cv AS MATERIALIZED (SELECT s.station, s.config_id, s.cutoff, d.ds, CAST(d.ds - s.cutoff AS INTEGER) AS horizon, d.y, s.sigma, list_dot_product({standard}, s.beta) * s.peak AS yhat
  FROM fitted s JOIN design d ON d.station = s.station AND d.ds > s.cutoff AND d.ds <= s.cutoff + s.h AND d.y IS NOT NULL),
cvi AS (SELECT * EXCLUDE (sigma), yhat - {interval_z(width)!r}::DOUBLE * sigma AS lo, yhat + {interval_z(width)!r}::DOUBLE * sigma AS hi FROM cv),
scored AS (SELECT s.station, s.config_id, s.cutoff, s.n, d.ds, d.y, s.sigma, list_dot_product({standard}, s.beta) * s.peak AS yhat FROM fitted s JOIN design d ON d.station = s.station)"""
