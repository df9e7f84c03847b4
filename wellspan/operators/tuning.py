"""Parameter grids, sweeps, parameter resolution and the run log."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wellspan import schemas
from wellspan.functions.text import typed_params
from wellspan.operators.folds import rolling_cutoffs, without_cutoffs
from wellspan.operators.frames import lag_names, lagged_frame
from wellspan.operators.metrics import cv_summary, select_score, top_configs
from wellspan.operators.models import fit_additive, score, sweep_sums
from wellspan.session import reuse
from wellspan.sources.feeds import union_frames


def grid_configs(grid: dict[str, list] | None = None) -> list[dict]:
    """Every combination of the grid, in order; the position is the configuration id."""
    grid = grid or schemas.PARAM_GRID
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _grid(configs: list[dict]) -> Column:
    """The grid as an array of rows, from literals."""
    return F.array(*[
        F.struct(F.lit(i).alias("config_id"), *[F.lit(float(v)).alias(k) for k, v in c.items()])
        for i, c in enumerate(configs)
    ])


def grid_frame(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """The grid as rows."""
    return spark.range(1).select(F.inline(_grid(configs)))


def lagged_all(daily: DataFrame, keys: list[str], t: str, y: str, columns: list[str], horizons) -> DataFrame:
    """Lagged frames of all horizons as one table keyed by ``h``; a regressor keeps its own name."""
    parts = []
    for h in horizons:
        frame = lagged_frame(daily, keys, t, y, columns, h).withColumn("h", F.lit(h))
        parts.append(frame.withColumnsRenamed(dict(zip(lag_names(columns, h), columns))))
    return union_frames(*parts)


def tune(
    daily: DataFrame, keys: list[str], t: str, y: str, columns: list[str],
    horizons: tuple[int, ...] = schemas.HORIZONS, configs: list[dict] | None = None,
    period: int = schemas.CV_PERIOD_DAYS, fraction: float = schemas.CV_INITIAL_FRACTION,
) -> DataFrame:
    """Metrics and selection score of every configuration for every horizon.

    All stations, horizons, folds and configurations are one job. A configuration that fails to
    solve, or has no fold to be tested on, keeps its row, with NULL metrics and ``error`` set; the
    others are not affected.
    """
    configs = configs or grid_configs()
    by = [*keys, "h"]
    frame = reuse(lagged_all(daily, keys, t, y, columns, horizons).dropna(subset=["y", *columns]))
    cutoffs = rolling_cutoffs(frame, by, "ds", F.col("h"), period, fraction=fraction)
    sums = sweep_sums(frame, cutoffs, by, columns, configs, "h")
    spread = frame.groupBy(*by).agg(F.stddev_samp("y").alias("std_y"))
    summary = cv_summary(sums, spread, [*by, "config_id"], by, summed=True)
    scored = select_score(summary, schemas.LAMBDA_DEGRADATION, schemas.LAMBDA_SPREAD)
    short = without_cutoffs(frame, by, "ds", F.col("h"), fraction=fraction).withColumnRenamed("reason", "_short")
    asked = frame.select(*by).distinct().select(*by, F.inline(_grid(configs)))
    found = F.lit(True).alias("_found")
    rows = asked.join(scored.select("*", found), [*by, "config_id"], "left").join(short, by, "left")
    error = F.when(F.col("_found").isNull(), F.coalesce("_short", F.lit("no fold could be solved and tested")))
    return rows.withColumn("error", error).drop("_found", "_short").withColumnRenamed("h", "horizon")


def refit_best(
    daily: DataFrame, keys: list[str], t: str, y: str, columns: list[str], h: int, results: DataFrame,
    configs: list[dict] | None = None, width: float = 0.8,
) -> DataFrame:
    """Winning configuration per station refitted on all rows; forecast over history and ``h`` days.

    Each row says which configuration, last training day and number of rows it comes from.
    """
    configs = configs or grid_configs()
    frame = reuse(lagged_frame(daily, keys, t, y, columns, h).dropna(subset=lag_names(columns, h)))
    last = frame.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max("ds").alias("cutoff"))
    models = fit_additive(frame, last, keys, lag_names(columns, h), configs)
    best = top_configs(results.where((F.col("horizon") == h) & F.col("error").isNull()), keys, 1).select(*keys, "config_id")
    return score(frame, models.join(best, [*keys, "config_id"]), keys, lag_names(columns, h), width)


def resolve_params(
    targets: DataFrame, production: DataFrame, tuning_best: DataFrame, on: list[str]
) -> DataFrame:
    """Parameters of the production run, else those of the best tuning row, typed by name.

    ``production`` and ``tuning_best``: ``on`` and a string map ``params``; production also has
    ``version``.
    """
    prod = production.select(*on, F.col("params").alias("_prod"), F.col("version").alias("previous_version"))
    tuned = tuning_best.select(*on, F.col("params").alias("_tuned"))
    return (
        targets.join(prod, on, "left").join(tuned, on, "left")
        .withColumn("_p", typed_params(F.coalesce("_prod", "_tuned")))
        .select(
            *on, "previous_version",
            F.when(F.col("_prod").isNotNull(), F.lit("production"))
            .when(F.col("_tuned").isNotNull(), F.lit("tuning")).alias("params_from"),
            "_p.*",
        )
    )


def _text_map(columns: list[str]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns])
    )


def model_runs(
    results: DataFrame, on: list[str], params: list[str], metrics: list[str], tags: list[str],
    trained_to: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Append-only run log rows: parameter, metric and tag maps, and the columns to ``keep``.

    ``trained_to``, the last training day, tells runs of equal parameters on new data apart.
    """
    parts = [*on, *params, *([trained_to] if trained_to else [])]
    run_id = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    numbers = F.map_from_arrays(
        F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics])
    )
    return results.select(
        *on, run_id.alias("run_id"), _text_map(params).alias("params"), numbers.alias("metrics"),
        _text_map(tags).alias("tags"), *(keep or []),
    )


def register_runs(history: DataFrame, new_runs: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The run log with ``new_runs`` added: next version numbers per model, one production row each.

    ``history`` has ``on`` and ``version``, and may lack other columns of a run. New runs are numbered in
    the ``order`` given; the newest version of a model takes the production alias from the others.
    """
    both = history.withColumn("_new", F.lit(0)).unionByName(new_runs.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    model = Window.partitionBy(*on)
    numbered = both.withColumns({
        "_base": F.coalesce(F.max(F.when(F.col("_new") == 0, F.col("version"))).over(model), F.lit(0)),
        "_at": F.row_number().over(Window.partitionBy(*on, "_new").orderBy(*order)),
    }).withColumn("version", F.when(F.col("_new") == 1, F.col("_base") + F.col("_at")).otherwise(F.col("version")).cast("int"))
    columns = [c for c in new_runs.columns if c not in ("version", "previous_version", "is_production")]
    return numbered.select(
        *columns, "version", F.lag("version").over(model.orderBy("version")).alias("previous_version"),
        (F.col("version") == F.max("version").over(model)).alias("is_production"),
    )
