"""The retrain job: parameters of the production model, fit on what has been delivered, register, promote.

Two tables outlive the job and are only ever added to, by Spark's own writer:

* ``runs``: a row for each fit that succeeded, with its version, parameters, metrics, tags and the model itself;
* ``promotions``: a row for each time the production alias of a model moved.

The alias of a model is at the version promoted last. Versions are written before promotions, so a job that
is lost in between leaves the old version in production, and the next one goes on from the highest version.
A model whose fit fails keeps its version. One job at a time may retrain a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wellspan import schemas
from wellspan.operators.models import fit_additive
from wellspan.operators.tuning import lagged_all, model_runs, register_runs, resolve_params
from wellspan.session import materialize, reuse
from wellspan.streaming.jobs import read_if_there

PARAMS = {"changepoint_prior_scale": 0.05, "seasonality_prior_scale": 10.0, "changepoint_range": 0.8}
MODEL = ["first_day", "unit_days", "coef", "sigma"]
_RUN = "run_id string, params map<string,string>, metrics map<string,double>, tags map<string,string>, version int, trained_to date, n_train bigint, params_from string, first_day date, unit_days int, coef array<double>, sigma double"


def _keys(df: DataFrame, on: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in on)


def run_table(spark: SparkSession, store: str, keys: str) -> DataFrame:
    return read_if_there(spark, f"{store}/runs", T.StructType.fromDDL(f"{keys}, {_RUN}"))


def production_runs(spark: SparkSession, store: str, keys: str, on: list[str]) -> DataFrame:
    """The run that each model's production alias points to; ``keys`` declares the columns ``on``."""
    moves = read_if_there(spark, f"{store}/promotions", T.StructType.fromDDL(f"{keys}, version int, move bigint"))
    alias = moves.groupBy(*on).agg(F.max_by("version", "move").alias("version"))
    return run_table(spark, store, keys).join(alias, [*on, "version"])


def retrain(
    daily: DataFrame, keys: list[str], t: str, y: str, columns: list[str], store: str, tuning_best: DataFrame,
    horizons: tuple[int, ...] = schemas.HORIZONS,
) -> DataFrame:
    """Retrain the model of every station and horizon on ``daily`` and move production to it.

    ``tuning_best``: keys, ``h`` and a string map ``params``, for models that have no production version yet.
    Returns a row for each model: its new version, the one that was in production, where the parameters came
    from, what it was trained on, or the error that kept the old version in place.
    """
    spark = daily.sparkSession
    by = [*keys, "h"]
    frame = reuse(lagged_all(daily, keys, t, y, columns, horizons).dropna(subset=["y", *columns]))
    declared = _keys(frame, by)
    ends = frame.groupBy(*by).agg(F.max("ds").alias("cutoff"))
    production = production_runs(spark, store, declared, by)
    resolved = resolve_params(ends.select(*by), production, tuning_best, by)
    used = resolved.select(*by, "previous_version", "params_from", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in PARAMS.items()])
    marks = ends.join(used, by)
    fits = fit_additive(frame, marks.select(*by, "cutoff", *PARAMS), by, columns, None).drop("config_id", "cutoff")
    results = materialize(fits.join(marks, by), "retrained")
    runs = model_runs(results.where("error IS NULL").withColumnRenamed("cutoff", "trained_to"), by, list(PARAMS), ["sigma", "n_train"], ["h"],
                      trained_to="trained_to", keep=["trained_to", "n_train", "params_from", *MODEL])
    before = run_table(spark, store, declared).groupBy(*by).agg(F.max("version").alias("version"))
    numbered = register_runs(before, runs, by, ["run_id"]).where(F.col("run_id").isNotNull()).drop("previous_version", "is_production")
    new = materialize(numbered, "registered")
    new.write.mode("append").parquet(f"{store}/runs")
    # the moves of one model are in the order of its versions
    new.select(*by, "version", F.col("version").cast("bigint").alias("move")).write.mode("append").parquet(f"{store}/promotions")
    frame.unpersist()
    return results.select(*by, "previous_version", "params_from", *PARAMS, "n_train", F.col("cutoff").alias("trained_to"), "error").join(
        new.select(*by, F.col("version").alias("new_version"), "run_id"), by, "left")
