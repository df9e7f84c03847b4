"""Learned forecasters: linear and additive regression from Gram matrices, boosted trees.

Least squares only needs sums of products. Pooled fits compute them where the rows already are and
shuffle a matrix per task. The additive forecaster meets its station's rows once: a model for a cutoff
uses the sum of all segments up to it, so every fold and every configuration of a sweep comes from one
pass over them.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wellspan.operators import folds
from wellspan.session import materialize, reuse, spread
from wellspan.sources.feeds import union_frames

# The small task functions below travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

YEAR_DAYS = 365.25
FOURIER_ORDER = 10
KNOTS = 31
REGRESSOR_PRIOR = 10.0


def interval_z(width: float) -> float:
    """Half-width of a central normal interval in standard deviations."""
    return NormalDist().inv_cdf(0.5 + width / 2)


def partial_grams(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Sums of outer products of ``vector`` per group and Arrow batch.

    ``vector`` is a dense array<double> column; the output ``gram`` is the flattened square matrix
    of one batch, to be summed by group.
    """
    schema = T.StructType([df.schema[c] for c in by] + [
        T.StructField("gram", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()),
    ])
    arrow_by = list(by)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat = batch.column(batch.schema.get_field_index("_v")).flatten()
            rows = np.asarray(flat, dtype=float).reshape(batch.num_rows, -1)
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for c in arrow_by:
                labels = batch.column(batch.schema.get_field_index(c)).dictionary_encode("encode")
                codes = codes * len(labels.dictionary) + labels.indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes, return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.diff(codes[order])) + 1
            members = np.split(order, edges)
            firsts = pa.array([m[0] for m in members])
            sums = [rows[m].T @ rows[m] for m in members]
            columns = [batch.column(batch.schema.get_field_index(c)).take(firsts) for c in arrow_by]
            columns.append(pa.array([g.ravel() for g in sums], pa.list_(pa.float64())))
            columns.append(pa.array([len(m) for m in members], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*arrow_by, "gram", "n"])

    return df.select(*by, F.col(vector).alias("_v")).mapInArrow(grams, schema)


def _stack(table: pa.Table) -> np.ndarray:
    flat = np.asarray(table.column("gram").combine_chunks().flatten(), dtype=float)
    side = int(round((len(flat) / table.num_rows) ** 0.5))
    return flat.reshape(table.num_rows, side, side)


def _solve(gram: np.ndarray, p: int, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ridge coefficients of the last column on the first ``p``, one row per row of penalties, and
    the residual sums of squares."""
    xx, xy, yy = gram[:p, :p], gram[:p, -1], gram[-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    systems = np.repeat((xx / np.outer(scale, scale))[None], len(penalties), axis=0)
    systems[:, np.arange(p), np.arange(p)] += penalties / scale**2
    right = xy / scale
    try:
        np.linalg.cholesky(systems)  # raises unless all are well posed
        betas = np.linalg.solve(systems, np.repeat(right[None, :, None], len(penalties), axis=0))[:, :, 0]
    except np.linalg.LinAlgError:  # singular: least-norm solution
        betas = np.array([np.linalg.lstsq(a, right, rcond=1e-12)[0] for a in systems])
    betas = betas / scale
    rss = yy - 2 * betas @ xy + np.einsum("ij,jk,ik->i", betas, xx, betas)
    return betas, np.maximum(rss, 0.0)


def _least_squares(gram: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """Coefficients of the last columns of a Gram matrix on its first ``p``, and the rank of these.

    Columns are scaled to unit length and taken in the order of what is left of them (a pivoted Cholesky
    factor); those that others explain get coefficient 0.
    """
    scale = np.sqrt(np.where(np.diag(gram)[:p] > 0, np.diag(gram)[:p], 1.0))
    a, b = gram[:p, :p] / np.outer(scale, scale), gram[:p, p:] / scale[:, None]
    left, chosen = np.diag(a).copy(), []
    factor = np.zeros((p, p))
    for k in range(p):
        left[chosen] = -1.0
        at = 0 if k == 0 else int(np.argmax(left))  # the intercept first
        if left[at] < 1e-10:
            break
        factor[:, k] = (a[:, at] - factor[:, :k] @ factor[at, :k]) / np.sqrt(left[at])
        chosen.append(at)
        left = left - factor[:, k] ** 2
    lower = factor[np.ix_(chosen, range(len(chosen)))]
    coef = np.zeros((p, gram.shape[1] - p))
    coef[chosen] = np.linalg.solve(lower.T, np.linalg.solve(lower, b[chosen]))
    return coef / scale[:, None], len(chosen)


def fit_linear(df: DataFrame, by: list[str], features: list[str], target: str | list[str]) -> DataFrame:
    """Ordinary least squares per group: ``coef`` holds the intercept, then the features.

    Several targets share one pass and one Gram matrix for each set of known targets: a row counts for the
    targets it has. They come as rows told apart by ``target``. ``rank`` is the number of columns that
    aren't explained by others; those that are have coefficient 0.
    """
    targets = [target] if isinstance(target, str) else list(target)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    # unknown targets as 0 with a mark, by which the rows are summed apart
    ys = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in targets]
    mask = sum((F.col(c).isNotNull().cast("int") * F.lit(1 << i) for i, c in enumerate(targets)), F.lit(0))
    rows = df.dropna(subset=features).select(*by, mask.alias("_known"), F.array(*x, *ys).alias("v")).where("_known > 0")
    schema = T.StructType([df.schema[c] for c in by] + [
        T.StructField("target", T.StringType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType()),
        T.StructField("n_train", T.LongType()), T.StructField("rank", T.IntegerType()),
    ])
    arrow_by, p = list(by), len(features) + 1

    def solve(table: pa.Table) -> pa.Table:
        grams, counts, known = _stack(table), np.asarray(table.column("n")), np.asarray(table.column("_known"))
        found: dict[str, list] = {c: [] for c in ("target", "coef", "rss", "n_train", "rank")}
        for i, name in enumerate(targets):
            mine = (known >> i) & 1 == 1
            if not mine.any():
                continue
            gram = grams[mine].sum(axis=0)[np.ix_([*range(p), p + i], [*range(p), p + i])]
            beta, rank = _least_squares(gram, p)
            b = beta[:, 0]
            rss = gram[p, p] - 2 * b @ gram[:p, p] + b @ gram[:p, :p] @ b
            for c, v in zip(found, (name, b.tolist(), max(float(rss), 0.0), int(counts[mine].sum()), rank)):
                found[c].append(v)
        n = len(found["target"])
        out = pa.table({**{c: table.column(c).take(pa.array([0] * n, pa.int64())) for c in arrow_by}, **found})
        return out.cast(pa.schema([*(table.schema.field(c) for c in arrow_by), ("target", pa.string()), ("coef", pa.list_(pa.float64())),
                                   ("rss", pa.float64()), ("n_train", pa.int64()), ("rank", pa.int32())]))

    models = spread(partial_grams(rows, [*by, "_known"], "v"), *by).groupBy(*by).applyInArrow(solve, schema)
    return models.drop("target") if isinstance(target, str) else models


def predict_linear(df: DataFrame, models: DataFrame, by: list[str], features: list[str], out: str = "yhat") -> DataFrame:
    """``df`` with the prediction of its group's model; with several targets a row for each of them."""
    yhat = F.element_at("coef", 1)
    for i, c in enumerate(features):
        yhat = yhat + F.element_at("coef", i + 2) * F.col(c).cast("double")
    return df.join(models.drop("rss", "rank"), by).withColumn(out, yhat).drop("coef")


# --- additive model -----------------------------------------------------------------------
#
# A station's daily rows are bounded by the calendar. They meet its cutoffs in one task, which adds up a
# Gram matrix for each segment between cutoffs; the running sums are the folds. Scale and centre of a fold
# come from the moments its own matrix holds, so no fold has seen a day after its cutoff.

_MODEL = [
    T.StructField("cutoff", T.DateType()), T.StructField("config_id", T.IntegerType()),
    T.StructField("first_day", T.DateType()), T.StructField("unit_days", T.IntegerType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType()),
    T.StructField("n_train", T.LongType()), T.StructField("error", T.StringType()),
]


def _basis(days: np.ndarray, first: int, unit: int, n_knots: int, regressors: np.ndarray) -> np.ndarray:
    """Intercept, slope, trend hinges, yearly Fourier pairs, regressors; time counts ``unit`` days from ``first``."""
    time = (days - first) / unit
    knots = np.arange(1, n_knots + 1) / (KNOTS + 1)
    angle = days[:, None] * (2 * np.pi / YEAR_DAYS) * np.arange(1, FOURIER_ORDER + 1)
    waves = np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(days), -1)
    return np.column_stack([np.ones(len(days)), time, np.maximum(time[:, None] - knots, 0.0), waves, regressors])


def _prior_scales(config: dict, reach: float, n_knots: int, n_regressors: int) -> np.ndarray:
    """Prior scales of the coefficients when time runs from 0 to ``reach`` over the training rows."""
    return np.concatenate([
        [5.0, 5.0 / reach], np.full(n_knots, config["changepoint_prior_scale"] / reach),
        np.full(2 * FOURIER_ORDER, config["seasonality_prior_scale"]), np.full(n_regressors, REGRESSOR_PRIOR),
    ])


def _fit_folds(days: np.ndarray, y: np.ndarray, regressors: np.ndarray, cutoffs: np.ndarray, configs: list[dict]) -> list[dict]:
    """A model for every cutoff and configuration, coefficients for raw regressors and levels.

    Knots stand at equal distances, ``KNOTS`` of them up to the first cutoff and on in the same step; a
    fold uses those within ``changepoint_range`` of its training span. Penalties are noise variance over
    squared prior scale; the noise comes from a nearly unpenalised first fit.
    """
    cutoffs = np.unique(cutoffs)
    seen = days <= cutoffs[-1]
    days, y, regressors = days[seen], y[seen], regressors[seen]
    blank = {"coef": None, "sigma": None, "first_day": None, "unit_days": None}
    if not len(days):
        return [{"cutoff": c, "config_id": i, "n_train": 0, "error": "no training rows", **blank} for c in cutoffs for i in range(len(configs))]
    first = int(days.min())
    unit = max(int(cutoffs[0]) - first, 1)
    n_knots = max(int(np.ceil((int(cutoffs[-1]) - first) / unit * (KNOTS + 1))) - 1, 0)
    r = regressors.shape[1]
    p = 2 + n_knots + 2 * FOURIER_ORDER + r
    # numerical conditioning only, by rows that every fold trains on; each fold rescales by its own moments
    early = regressors[days <= cutoffs[0]]
    centre0 = early.mean(axis=0) if len(early) else np.zeros(r)
    spread0 = early.std(axis=0) if len(early) else np.ones(r)
    spread0 = np.where(spread0 > 0, spread0, 1.0)
    rows = np.column_stack([_basis(days, first, unit, n_knots, (regressors - centre0) / spread0), y])
    segment = np.searchsorted(cutoffs, days, "left")
    gram, n, peak, out = np.zeros((p + 1, p + 1)), 0, 0.0, []
    for k, cutoff in enumerate(cutoffs):
        mine = rows[segment == k]
        with np.errstate(all="ignore"):
            gram, n = gram + mine.T @ mine, n + len(mine)
        peak = max(peak, float(np.abs(mine[:, -1]).max(initial=0.0)))
        head = {"cutoff": cutoff, "n_train": n}
        if not n or not np.isfinite(gram).all():
            reason = "sums of the training rows are not finite" if n else "no training rows"
            out += [{**head, "config_id": i, "error": reason, **blank} for i in range(len(configs))]
            continue
        scale = peak or 1.0
        mean = gram[0, p - r:p] / n
        spread = np.sqrt(np.maximum(np.diag(gram)[p - r:p] / n - mean**2, 0.0))
        varies = spread > 1e-9 * np.sqrt(np.maximum(np.diag(gram)[p - r:p] / n, 1.0))
        change = np.eye(p + 1)  # to columns standardised over the fold
        at = np.arange(p - r, p)
        safe = np.where(varies, spread, 1.0)
        change[at, at], change[at, 0], change[p, p] = 1 / safe, -mean / safe, 1 / scale
        own = change @ gram @ change.T
        reach = max((int(cutoff) - first) / unit, 1e-9)
        knots = np.arange(1, n_knots + 1) / (KNOTS + 1)
        for share in sorted({c["changepoint_range"] for c in configs}):
            members = [i for i, c in enumerate(configs) if c["changepoint_range"] == share]
            keep = np.ones(p, bool)
            keep[2:2 + n_knots] = knots <= reach * share
            keep[p - r:] = varies
            index = np.append(np.flatnonzero(keep), p)
            part, size = own[np.ix_(index, index)], int(keep.sum())
            try:
                _, loose = _solve(part, size, np.full((1, size), 1e-9))
                noise = max(loose[0] / n, 1e-12)
                priors = np.array([_prior_scales(configs[i], reach, n_knots, r) for i in members])[:, keep]
                betas, rss = _solve(part, size, noise / priors**2)
            except np.linalg.LinAlgError as failure:
                out += [{**head, "config_id": i, "error": str(failure), **blank} for i in members]
                continue
            coefs = np.zeros((len(members), p))
            coefs[:, keep] = betas
            coefs = scale * coefs @ change[:p, :p]
            coefs[:, p - r:] /= spread0
            coefs[:, 0] -= coefs[:, p - r:] @ centre0
            out += [{**head, "config_id": i, "coef": c, "sigma": scale * float(np.sqrt(q / n)), "first_day": first, "unit_days": unit, "error": None}
                    for i, c, q in zip(members, coefs, rss)]
    return out


def _predict(model: dict, days: np.ndarray, regressors: np.ndarray) -> np.ndarray:
    n_knots = len(model["coef"]) - 2 - 2 * FOURIER_ORDER - regressors.shape[1]
    return _basis(days, model["first_day"], model["unit_days"], n_knots, regressors) @ model["coef"]


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int32()).to_numpy().astype(np.int64)


def _numbers(table: pa.Table, columns: list[str]) -> np.ndarray:
    if not columns:
        return np.empty((table.num_rows, 0))
    return np.column_stack([np.asarray(table.column(c).to_numpy(), dtype=float) for c in columns])


def _by_station(frame: DataFrame, other: DataFrame, by: list[str], regressors: list[str], out: list[T.StructField], step) -> DataFrame:
    """``step(days, y, regressors, other)`` for each group's complete rows in order of day, beside its rows of ``other``.

    Returns a dict of columns, whose group keys are added.
    """
    rows = frame.select(*by, "ds", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in regressors])
    rows = rows.dropna(subset=regressors) if regressors else rows
    schema = T.StructType([frame.schema[c] for c in by] + out)
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in out])
    names, regs = list(by), list(regressors)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("ds")
        keys = (left if left.num_rows else right).select(names).slice(0, 1)
        found = step(_days(left.column("ds")), np.asarray(left.column("y").to_numpy(), dtype=float), _numbers(left, regs), right)
        table = pa.table(found, schema=arrow)
        for i, c in enumerate(names):
            table = table.add_column(i, c, keys.column(c).take(pa.array(np.zeros(table.num_rows, np.int64))))
        return table

    # both sides may come from one table, so one gets columns of its own
    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    # few bytes and much work: explicit counts keep adaptive execution from merging the groups
    return spread(rows, *by).groupBy(*by).cogroup(spread(other, *by).groupBy(*by)).applyInArrow(run, schema)


_ARROW = {
    "date": pa.date32(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
    "array<double>": pa.list_(pa.float64()),
}


def _columns(records: list[dict], fields: list[T.StructField]) -> dict:
    """Records as Arrow columns; days since 1970 become dates."""
    out = {}
    for f in fields:
        values, kind = [r[f.name] for r in records], _ARROW[f.dataType.simpleString()]
        if kind == pa.date32():
            out[f.name] = pa.array([None if v is None else int(v) for v in values], pa.int32()).cast(kind)
        else:
            out[f.name] = pa.array(values, kind)
    return out


def _configs_of(table: pa.Table, configs: list[dict] | None) -> list[dict]:
    """The grid, or without one the group's own parameters, columns of ``table``."""
    if configs is not None:
        return configs
    row = table.slice(0, 1).to_pylist()[0]
    return [{c: float(row[c]) for c in ("changepoint_prior_scale", "seasonality_prior_scale", "changepoint_range")}]


def fit_additive(
    frame: DataFrame, cutoffs: DataFrame, by: list[str], regressors: list[str], configs: list[dict] | None,
) -> DataFrame:
    """Additive models for every (group, cutoff, configuration): trend hinges, yearly season, regressors.

    ``frame``: ``by``, ``ds``, ``y``, regressors; ``cutoffs``: ``by`` and ``cutoff``, and the parameters of
    the group if ``configs`` is None. A model uses the rows up to its cutoff that have a level and all
    regressors, and nothing else. One that cannot be solved gives a row with ``error`` set.
    """

    def step(days, y, regs, marks):
        if not marks.num_rows:
            return _columns([], _MODEL)
        known = ~np.isnan(y)
        return _columns(_fit_folds(days[known], y[known], regs[known], _days(marks.column("cutoff")), _configs_of(marks, configs)), _MODEL)

    return _by_station(frame, cutoffs, by, regressors, _MODEL, step)


_FOLD_ROW = [
    T.StructField("config_id", T.IntegerType()), T.StructField("cutoff", T.DateType()), T.StructField("ds", T.DateType()),
    T.StructField("horizon", T.IntegerType()), T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType()),
    T.StructField("yhat_lower", T.DoubleType()), T.StructField("yhat_upper", T.DoubleType()),
]


def _tested(days, y, regs, marks, configs, h):
    """For each cutoff with test rows: the places of these, all models that could be solved, predictions by model."""
    cutoffs = _days(marks.column("cutoff"))
    known = ~np.isnan(y)
    days, y, regs = days[known], y[known], regs[known]
    ahead = h if isinstance(h, int) else int(marks.column(h)[0].as_py())
    fitted: dict[int, list[dict]] = {}
    for m in _fit_folds(days, y, regs, cutoffs, configs):
        if m["error"] is None:
            fitted.setdefault(int(m["cutoff"]), []).append(m)
    for cutoff, models in sorted(fitted.items()):
        rows = np.flatnonzero((days > cutoff) & (days <= cutoff + ahead))
        if len(rows):
            one = models[0]
            n_knots = len(one["coef"]) - 2 - 2 * FOURIER_ORDER - regs.shape[1]
            x = _basis(days[rows], one["first_day"], one["unit_days"], n_knots, regs[rows])
            yield cutoff, days[rows], y[rows], models, x @ np.array([m["coef"] for m in models]).T


def backtest_additive(
    frame: DataFrame, cutoffs: DataFrame, by: list[str], regressors: list[str], configs: list[dict], h: int | str, width: float = 0.8,
) -> DataFrame:
    """Predictions of every fold and configuration over its test days, the ``h`` days after its cutoff.

    ``h`` is a number or the key column that holds it. Fits and predictions of a station are one task; all
    configurations of a fold are one matrix product.
    """
    z = interval_z(width)

    def step(days, y, regs, marks):
        out: dict[str, list] = {f.name: [] for f in _FOLD_ROW}
        for cutoff, at, seen, models, yhat in (_tested(days, y, regs, marks, configs, h) if marks.num_rows else ()):
            half = z * np.array([m["sigma"] for m in models])
            size = yhat.size
            out["config_id"].append(np.tile([m["config_id"] for m in models], len(at)))
            out["cutoff"].append(np.full(size, cutoff))
            out["ds"].append(np.repeat(at, len(models)))
            out["horizon"].append(np.repeat(at - cutoff, len(models)))
            out["y"].append(np.repeat(seen, len(models)))
            for name, v in (("yhat", yhat), ("yhat_lower", yhat - half), ("yhat_upper", yhat + half)):
                out[name].append(v.ravel())
        whole = {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}
        return {f.name: pa.array(whole[f.name].astype(np.int32)).cast(_ARROW[f.dataType.simpleString()]) if f.dataType.simpleString() in ("date", "int")
                else pa.array(whole[f.name], pa.float64()) for f in _FOLD_ROW}

    return _by_station(frame, cutoffs, by, regressors, _FOLD_ROW, step)


_SUMS = [
    T.StructField("config_id", T.IntegerType()), T.StructField("horizon", T.IntegerType()), T.StructField("_m", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("_se", "_ae", "_ape", "_inside", "_y_mean", "_y_ss")],
]


def sweep_sums(
    frame: DataFrame, cutoffs: DataFrame, by: list[str], regressors: list[str], configs: list[dict], h: int | str, width: float = 0.8,
) -> DataFrame:
    """The error sums of :func:`backtest_additive` by configuration and days ahead, as ``metrics.horizon_sums`` has them.

    They are added up in the task that predicts, so a sweep hands on a row for each configuration and day
    ahead instead of one for each prediction.
    """
    z = interval_z(width)

    def step(days, y, regs, marks):
        blocks: dict[tuple[int, int], list[tuple]] = {}
        for cutoff, at, seen, models, yhat in (_tested(days, y, regs, marks, configs, h) if marks.num_rows else ()):
            for m, column in zip(models, yhat.T):
                for d, v, f in zip(at - cutoff, seen, column):
                    blocks.setdefault((m["config_id"], int(d)), []).append((v, f, z * m["sigma"]))
        records = []
        for (config, horizon), rows in sorted(blocks.items()):
            v, f, half = np.array(rows).T
            off = np.abs(v - f)
            apes = off[v != 0] / np.abs(v[v != 0])
            records.append({
                "config_id": config, "horizon": horizon, "_m": len(v), "_se": float(off @ off), "_ae": float(off.sum()),
                "_ape": float(apes.sum()) if len(apes) else None, "_inside": float(((v >= f - half) & (v <= f + half)).sum()),
                "_y_mean": float(v.mean()), "_y_ss": float(((v - v.mean()) ** 2).sum()),
            })
        return _columns(records, _SUMS)

    return _by_station(frame, cutoffs, by, regressors, _SUMS, step)


_SCORED = [T.StructField("ds", T.DateType()), T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType()), T.StructField("sigma", T.DoubleType()),
           T.StructField("config_id", T.IntegerType()), T.StructField("cutoff", T.DateType()), T.StructField("n_train", T.LongType())]


def predictions(frame: DataFrame, models: DataFrame, by: list[str], regressors: list[str]) -> DataFrame:
    """Batch scoring of a frame, one model per group and one matrix product each.

    Every row carries what its model was fitted on: ``config_id``, ``cutoff``, ``n_train``. Groups without a
    model give no rows; rows that lack a regressor have no prediction and are left out.
    """

    def step(days, y, regs, fitted):
        if not fitted.num_rows or not len(days):
            return _columns([], _SCORED)
        m = fitted.slice(0, 1).to_pylist()[0]
        model = {"coef": np.array(m["coef"]), "first_day": _days(fitted.column("first_day"))[0], "unit_days": m["unit_days"]}
        size = len(days)
        return {
            "ds": pa.array(days.astype(np.int32)).cast(pa.date32()), "y": pa.array([None if np.isnan(v) else v for v in y], pa.float64()),
            "yhat": pa.array(_predict(model, days, regs)), "sigma": pa.array(np.full(size, m["sigma"])),
            "config_id": pa.array([m["config_id"]] * size, pa.int32()), "cutoff": pa.array([m["cutoff"]] * size, pa.date32()),
            "n_train": pa.array([m["n_train"]] * size, pa.int64()),
        }

    usable = models.where(F.col("error").isNull())
    return _by_station(frame, usable, by, regressors, _SCORED, step)


def score(frame: DataFrame, models: DataFrame, by: list[str], regressors: list[str], width: float = 0.8, interval: str = "residual") -> DataFrame:
    """:func:`predictions` with intervals from the quantiles of the group's own residuals, or from the fitted noise."""
    rows = predictions(frame, models, by, regressors)
    if interval == "residual":
        w = Window.partitionBy(*by)
        resid = F.col("y") - F.col("yhat")
        lower, upper = F.percentile(resid, (1 - width) / 2).over(w), F.percentile(resid, (1 + width) / 2).over(w)
    else:
        upper = F.col("sigma") * F.lit(interval_z(width))
        lower = -upper
    return rows.withColumns({"yhat_lower": F.col("yhat") + lower, "yhat_upper": F.col("yhat") + upper})


def error_quantiles(cv: DataFrame, by: list[str], width: float = 0.8) -> DataFrame:
    """Quantiles of out-of-sample errors by days ahead: ``low``, ``high`` and the number of folds behind them."""
    error = F.col("y") - F.col("yhat")
    return cv.groupBy(*by, "horizon").agg(
        F.percentile(error, (1 - width) / 2).alias("low"), F.percentile(error, (1 + width) / 2).alias("high"), F.count(error).alias("n_errors"))


def with_tested_interval(rows: DataFrame, quantiles: DataFrame, by: list[str], width: float = 0.8) -> DataFrame:
    """Forecast rows with the interval that the errors of a backtest give for their days ahead.

    ``rows``: output of :func:`predictions`. Days the model was fitted on, and days ahead that no fold
    tested, have the fitted noise instead; ``interval_from`` says which.
    """
    half = F.col("sigma") * F.lit(interval_z(width))
    ahead = rows.withColumn("horizon", F.greatest(F.date_diff("ds", "cutoff"), F.lit(0)))
    joined = ahead.join(quantiles, [*by, "horizon"], "left")
    return joined.select(
        *[c for c in rows.columns if c != "sigma"], "horizon", (F.col("yhat") + F.coalesce("low", -half)).alias("yhat_lower"),
        (F.col("yhat") + F.coalesce("high", half)).alias("yhat_upper"),
        F.when(F.col("low").isNotNull(), F.lit("backtest")).otherwise(F.lit("fit")).alias("interval_from"), "n_errors")


# --- boosted trees ------------------------------------------------------------------------

ROWS_PER_TASK = 50_000


def for_trees(df: DataFrame) -> DataFrame:
    """``df`` in as few partitions as its rows need: a fit is hundreds of small jobs over the same rows."""
    kept = reuse(df)
    return kept.coalesce(1 + kept.count() // ROWS_PER_TASK)


def fit_gbt(
    train: DataFrame, features: list[str], target: str, n_estimators: int = 100, learning_rate: float = 0.1,
    max_depth: int = 4, subsample: float = 0.8, colsample: float = 0.8, seed: int = 42,
):
    """Gradient-boosted trees on squared error; returns the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(
        featuresCol="_features", labelCol=target, predictionCol="yhat", maxIter=n_estimators,
        stepSize=learning_rate, maxDepth=max_depth, subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample), seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), gbt]).fit(train)


def gbt_backtest(
    tagged: DataFrame, keys: list[str], t: str, features: list[str], target: str, **params
) -> DataFrame:
    """Trees fitted on the ``train`` rows of all stations, predictions for ``train`` and ``test``.

    Stations differ in level, so the model learns the distance from the station's training mean,
    which is added back. One station gives the plain model.
    """
    w = Window.partitionBy(*keys)
    base = F.avg(F.when(F.col("split") == "train", F.col(target))).over(w)
    rows = for_trees(tagged.withColumn("_base", base).withColumn("_label", F.col(target) - F.col("_base")))
    model = fit_gbt(rows.where(F.col("split") == "train"), features, "_label", **params)
    return model.transform(rows).select(
        *keys, F.col(t).alias("ds"), "split", F.col(target).alias("y"),
        (F.col("yhat") + F.col("_base")).alias("yhat"),
    )


def walk_forward_tags(rows: DataFrame, keys: list[str], t: str, fraction: float = 0.8, start: dt.date | None = None, end: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the month and the calendar fold they are tested in (NULL before), and the folds of each station.

    A fold is a calendar month after the initial share of a station's rows, or from ``start`` (up to ``end``)
    on; it trains on the station's rows before the first one tested in it. Stations without the fold train on
    their rows before the month.
    """
    plan = folds.folds_from(rows, keys, t, start, end) if start else folds.monthly_folds(rows, keys, t, fraction)
    tagged = rows.withColumn("month", F.trunc(t, "MM")).join(plan.select(*keys, "month", "test_start", "test_end"), [*keys, "month"], "left")
    tested = F.col(t).between(F.col("test_start"), F.col("test_end"))
    return tagged.withColumn("fold_month", F.when(tested, F.col("month"))).drop("month", "test_start", "test_end"), plan


def gbt_walk_forward(
    rows: DataFrame, keys: list[str], t: str, features: list[str], target: str, fraction: float = 0.8,
    start: dt.date | None = None, end: dt.date | None = None, at_a_time: int = 8, **params,
) -> DataFrame:
    """Boosted trees refitted for every calendar month on all earlier rows, and their predictions.

    One model a month serves all stations: it learns the distance from each station's mean over its rows
    before the month. The tagged rows are kept once for all months; ``at_a_time`` fits run side by side, so
    that the small jobs of one fill the gaps of another. Returns a row for each prediction: keys, ``fold_month``,
    ``ds``, ``split``, ``y``, ``yhat``.
    """
    tagged, plan = walk_forward_tags(rows.dropna(subset=[*features, target]).select(*keys, t, *features, target), keys, t, fraction, start, end)
    tagged = reuse(tagged)
    months = [r["month"] for r in plan.select("month").distinct().orderBy("month").collect()]  # months, not rows

    def one(month: dt.date) -> DataFrame:
        mine = F.col("fold_month") == F.lit(month)
        began = F.min(F.when(mine, F.col(t))).over(Window.partitionBy(*keys))
        split = F.when(mine, F.lit("test")).when(F.col(t) < F.coalesce(began, F.lit(month)), F.lit("train"))
        part = tagged.withColumn("split", split).where(F.col("split").isNotNull())
        return materialize(gbt_backtest(part, keys, t, features, target, **params).withColumn("fold_month", F.lit(month)), "gbt-fold")

    with ThreadPoolExecutor(at_a_time) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), months))
    tagged.unpersist()
    return union_frames(*parts).select(*keys, "fold_month", "ds", "split", "y", "yhat")


def expanding_line(rows: DataFrame, cutoffs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One-regressor least squares on all rows up to each cutoff.

    Running regression aggregates over the station's rows, read off at the cutoffs: one window,
    no repetition of training rows per fold.
    """
    points = rows.select(*keys, F.col("ds").alias("at"), F.lit(0).alias("_cut"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    marks = cutoffs.select(*keys, F.col("cutoff").alias("at"), F.lit(1).alias("_cut")).distinct()
    w = Window.partitionBy(*keys).orderBy("at", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(marks, allowMissingColumns=True)
    pair = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    fitted = both.withColumns({
        "_sxy": F.covar_pop("_y", "_x").over(w),
        "_sxx": F.var_pop(F.when(pair, F.col("_x"))).over(w),
        "_mx": F.avg(F.when(pair, F.col("_x"))).over(w),
        "_my": F.avg(F.when(pair, F.col("_y"))).over(w),
        "n_train": F.count(F.when(pair, 1)).over(w),
    }).where(F.col("_cut") == 1)
    slope = F.try_divide("_sxy", "_sxx")
    return fitted.select(
        *keys, F.col("at").alias("cutoff"), slope.alias("slope"),
        (F.col("_my") - slope * F.col("_mx")).alias("intercept"), "n_train",
    )
