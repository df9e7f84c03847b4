"""Forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.functions.labels import blowup_label, calibration_label, skill_label
from wellspan.functions.stats import mape, r_squared, ratio, rmse


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat", ds: str = "ds") -> DataFrame:
    """R2, RMSE, MAE, MAPE in percent, bias, length in days and target variance per group."""
    a, b = F.col(y), F.col(yhat)
    return df.groupBy(*by).agg(
        r_squared(a, b).alias("r2"),
        rmse(a, b).alias("rmse"),
        F.avg(F.abs(a - b)).alias("mae"),
        (mape(a, b) * 100).alias("mape_pct"),
        F.avg(b - a).alias("bias"),
        (F.date_diff(F.max(ds), F.min(ds)) + 1).alias("length_days"),
        F.var_samp(a).alias("variance"),
        F.count(F.lit(1)).alias("n"),
    )


def split_metrics(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Fit on training rows and quality on test rows per group; ``split`` tells them apart.

    R2 of both, RMSE, MAE, MAPE in percent, bias and target variance of the test rows.
    """
    train, test = F.col("split") == "train", F.col("split") == "test"
    a, b = F.when(test, F.col(y)), F.when(test, F.col(yhat))
    return df.groupBy(*by).agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
        r_squared(F.when(train, F.col(y)), F.when(train, F.col(yhat))).alias("r2_train"), r_squared(a, b).alias("r2_test"),
        rmse(a, b).alias("rmse"), F.avg(F.abs(a - b)).alias("mae"), (mape(a, b) * 100).alias("mape_pct"),
        F.avg(b - a).alias("bias"), F.var_samp(a).alias("variance"),
    )


def with_fold_mean(per_fold: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """The folds, and a row without a fold that has the unweighted means of the metrics."""
    numbers = ["r2_train", "r2_test", "rmse", "mae", "mape_pct", "bias", "variance"]
    means = per_fold.groupBy(*keys).agg(F.sum("n_test").alias("n_test"), F.max("n_train").alias("n_train"), *[F.avg(c).alias(c) for c in numbers])
    return per_fold.unionByName(means, allowMissingColumns=True)


def fold_summary(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Unweighted mean and spread over folds."""
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return metrics.groupBy(*by).agg(*aggs)


def horizon_metrics(cv: DataFrame, by: list[str], window: float = 0.1) -> DataFrame:
    """RMSE, MAE, MAPE and coverage by days ahead; see :func:`_horizon_table`."""
    return _horizon_table(cv, by, window).drop("_pooled")


def _horizon_table(cv: DataFrame, by: list[str], window: float) -> DataFrame:
    """RMSE, MAE, MAPE and coverage by days ahead, averaged over a trailing share of all rows.

    The average at a horizon covers the last ``window`` share of rows ending there; when that
    share begins inside an earlier horizon, this horizon counts with the missing part of its rows.
    With running totals ``S`` over running row counts ``C`` that is the rise of the piecewise
    linear curve ``S(C)`` over the last ``k`` rows, so the start value is one as-of lookup of
    ``C - k`` on the curve: a union and a running last value. Horizons with fewer than ``k`` rows
    up to them are left out. The windows run on one row per horizon. ``_pooled`` repeats the
    numbers over all rows of the group, so the backtest rows are read once.
    """
    return _horizon_curve(horizon_sums(cv, by), by, window)


def horizon_sums(cv: DataFrame, by: list[str]) -> DataFrame:
    """Rows, error sums, rows inside the interval, and mean and squared spread of the target, by days ahead."""
    y, p = F.col("y"), F.col("yhat")
    return cv.groupBy(*by, F.date_diff("ds", "cutoff").alias("horizon")).agg(
        F.count(F.lit(1)).alias("_m"),
        F.sum((y - p) * (y - p)).alias("_se"),
        F.sum(F.abs(y - p)).alias("_ae"),
        F.sum(F.abs(F.try_divide(y - p, y))).alias("_ape"),
        F.sum(F.when((y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper")), 1.0).otherwise(0.0)).alias("_inside"),
        F.avg("y").alias("_y_mean"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("_y_ss"),
    )


def _horizon_curve(sums: DataFrame, by: list[str], window: float) -> DataFrame:
    everything = Window.partitionBy(*by)
    per_day = sums.withColumn(
        "_grand", F.sum(F.col("_y_mean") * F.col("_m")).over(everything) / F.sum("_m").over(everything)
    )
    off = F.col("_y_mean") - F.col("_grand")
    sst = F.sum(F.col("_y_ss") + F.col("_m") * off * off).over(everything)
    pooled = F.struct(
        (F.lit(1.0) - F.try_divide(F.sum("_se").over(everything), sst)).alias("r2"),
        (F.sum("_inside").over(everything) / F.sum("_m").over(everything)).alias("coverage"),
        F.sum("_m").over(everything).alias("n"),
    )
    parts = ["_se", "_ae", "_ape", "_inside"]
    w = Window.partitionBy(*by).orderBy("horizon")
    total = F.sum("_m").over(Window.partitionBy(*by))
    curve = per_day.withColumns({
        "_c_end": F.sum("_m").over(w),
        "_k": F.greatest(F.floor(total * F.lit(window)), F.lit(1)),
        "_pooled": pooled,
        **{f"{s}_end": F.sum(s).over(w) for s in parts},
    })
    start_at, want_at = F.col("_c_end") - F.col("_m"), F.col("_c_end") - F.col("_k")
    segment = F.struct(
        "_m", start_at.alias("_c0"),
        *[F.struct((F.col(f"{s}_end") - F.col(s)).alias("_s0"), F.col(s).alias("_rise")).alias(s) for s in parts],
    )
    wanted = F.struct("horizon", "_k", "_pooled", *[F.col(f"{s}_end").alias(s) for s in parts])
    # each horizon as a piece of the curve and as a question to it, from the same row
    both = curve.withColumns({"_piece": segment, "_ask": wanted}).select(*by, F.inline(F.array(
        F.struct(
            start_at.alias("_at"), F.lit(0).alias("_side"), F.col("_piece").alias("_seg"),
            F.when(F.lit(False), F.col("_ask")).alias("_want"),
        ),
        F.struct(
            want_at.alias("_at"), F.lit(1).alias("_side"), F.when(F.lit(False), F.col("_piece")).alias("_seg"),
            F.col("_ask").alias("_want"),
        ),
    )))
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.where(F.col("_at") >= 0).withColumn(
        "_seg", F.last("_seg", ignorenulls=True).over(order)
    ).where(F.col("_side") == 1)
    part = (F.col("_at") - F.col("_seg._c0")) / F.col("_seg._m")

    def smoothed(s: str):
        start = F.col(f"_seg.{s}._s0") + F.col(f"_seg.{s}._rise") * part
        return (F.col(f"_want.{s}") - start) / F.col("_want._k")

    return found.select(
        *by, F.col("_want.horizon").alias("horizon"),
        F.sqrt(F.greatest(smoothed("_se"), F.lit(0.0))).alias("rmse"),
        smoothed("_ae").alias("mae"), smoothed("_ape").alias("mape"),
        smoothed("_inside").alias("coverage"), F.col("_want._pooled").alias("_pooled"),
    )


def coverage(cv: DataFrame, by: list[str]) -> DataFrame:
    inside = (F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))
    return cv.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"))


def cv_summary(
    cv: DataFrame, std_y: DataFrame, by: list[str], keys: list[str],
    window: float = 0.1, target_coverage: float | None = None, summed: bool = False,
) -> DataFrame:
    """One row per group: means over horizons, pooled R2, scale-free ratios and degradation.

    ``std_y``: keys and ``std_y``, the spread of the training target. ``summed`` says that ``cv`` holds
    the sums of :func:`horizon_sums` rather than backtest rows.
    """
    table = _horizon_curve(cv, by, window) if summed else _horizon_table(cv, by, window)
    over_h = table.groupBy(*by).agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("mape").alias("mape"),
        F.min_by("rmse", "horizon").alias("_first"), F.max_by("rmse", "horizon").alias("_last"),
        F.max("_pooled").alias("_pooled"),
    )
    out = (
        over_h.select(*by, "rmse", "mae", "mape", "_pooled.*", "_first", "_last").join(std_y, keys)
        .withColumns({
            "rmse_std_ratio": ratio(F.col("rmse"), F.col("std_y")),
            "rmse_mae": ratio(F.col("rmse"), F.col("mae")),
            "horizon_degradation": ratio(F.col("_last"), F.col("_first")),
        })
        .withColumns({
            "skill": skill_label(F.col("rmse_std_ratio")), "blowups": blowup_label(F.col("rmse_mae")),
        })
        .drop("_first", "_last")
    )
    if target_coverage is not None:
        out = out.withColumn("calibration", calibration_label(F.col("coverage"), target_coverage))
    return out


def error_by_horizon(cv: DataFrame, by: list[str]) -> DataFrame:
    """Signed error of every backtest row by days ahead."""
    return cv.select(
        *by, "cutoff", "ds", F.date_diff("ds", "cutoff").alias("horizon"),
        (F.col("yhat") - F.col("y")).alias("error"),
    )


def select_score(metrics: DataFrame, degradation_weight: float, spread_weight: float) -> DataFrame:
    """RMSE inflated by error growth over the horizon and by large single misses."""
    over = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - 1, F.lit(0.0)))
    score = (
        F.col("rmse")
        * (F.lit(1.0) + F.lit(degradation_weight) * over("horizon_degradation"))
        * (F.lit(1.0) + F.lit(spread_weight) * over("rmse_mae"))
    )
    return metrics.withColumn("select_score", score)


def top_configs(scored: DataFrame, by: list[str], n: int = 5, tie: str = "config_id") -> DataFrame:
    """Best ``n`` rows per group by selection score."""
    w = Window.partitionBy(*by).orderBy(F.col("select_score").asc_nulls_last(), tie)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
