"""Evaluation folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.functions.dates import month_start


def rolling_cutoffs(
    df: DataFrame, keys: list[str], ds: str, h: int | Column, period: int,
    initial_days: int | None = None, fraction: float = 0.8,
) -> DataFrame:
    """Rolling-origin cutoffs: from ``max - h`` back in ``period`` steps to ``min + initial``.

    ``initial`` is ``fraction`` of the span unless given in days. ``h`` may be one of the key
    columns, for several horizons at once. Stations too short for one cutoff yield none.
    """
    span = df.groupBy(*keys).agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
    days = F.date_diff("_b", "_a")
    initial = F.lit(initial_days) if initial_days is not None else F.floor(days * F.lit(fraction)).cast("int")
    span = span.select(
        *keys, F.date_sub("_b", h).alias("_last"), "_a", initial.alias("_initial")
    ).withColumn("_first", F.date_add("_a", F.col("_initial")))
    steps = F.sequence("_last", "_first", F.expr(f"interval -{int(period)} day"))
    return span.where(F.col("_last") >= F.col("_first")).select(*keys, F.explode(steps).alias("cutoff"))


def without_cutoffs(
    df: DataFrame, keys: list[str], ds: str, h: int | Column, initial_days: int | None = None, fraction: float = 0.8,
) -> DataFrame:
    """The stations that :func:`rolling_cutoffs` has no cutoff for, and why, so that none is lost silently."""
    span = df.groupBy(*keys).agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
    days = F.coalesce(F.date_diff("_b", "_a"), F.lit(0))
    initial = F.lit(initial_days) if initial_days is not None else F.floor(days * F.lit(fraction)).cast("int")
    short = F.coalesce(F.date_sub("_b", h) < F.date_add("_a", initial), F.lit(True))
    return span.where(short).select(*keys, F.concat(
        F.lit("span of "), days.cast("string"), F.lit(" days is shorter than the initial "), initial.cast("string"),
        F.lit(" and the horizon "), F.lit(h).cast("string")).alias("reason"))


def test_days(cutoffs: DataFrame, keys: list[str], h: int | Column) -> DataFrame:
    """The ``h`` days after each cutoff, as rows to equi-join with."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")  # lit keeps a column as it is
    return cutoffs.select(*keys, "cutoff", ahead).select(
        *keys, "cutoff", F.col("step").alias("horizon"), F.expr("date_add(cutoff, step)").alias("ds")
    )


def test_rows(df: DataFrame, cutoffs: DataFrame, keys: list[str], h: int | Column) -> DataFrame:
    """Rows in ``(cutoff, cutoff + h]`` of every fold; the range is unrolled into an equi-join."""
    return df.join(test_days(cutoffs, keys, h), [*keys, "ds"])


def assign_folds(df: DataFrame, cutoffs: DataFrame, keys: list[str], h: int) -> DataFrame:
    """Every fold with its training and test rows counted and bounded.

    A training row belongs to all later cutoffs; rather than repeating rows per fold, each row is
    put in the segment before its next cutoff and segment sums are accumulated over cutoffs.
    """
    rows = df.select(*keys, F.col("ds").alias("at"), F.lit(1).alias("_row"), F.lit(0).alias("_cut"))
    marks = cutoffs.select(*keys, F.col("cutoff").alias("at"), F.lit(0).alias("_row"), F.lit(1).alias("_cut"))
    w = Window.partitionBy(*keys).orderBy("at", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    train = (
        rows.unionByName(marks)
        .withColumns({
            "n_train": F.sum("_row").over(w),
            "train_end": F.max(F.when(F.col("_row") == 1, F.col("at"))).over(w),
        })
        .where(F.col("_cut") == 1)
        .select(*keys, F.col("at").alias("cutoff"), "n_train", "train_end")
    )
    test = test_rows(df.select(*keys, "ds"), cutoffs, keys, h).groupBy(*keys, "cutoff").agg(
        F.count(F.lit(1)).alias("n_test"), F.min("ds").alias("test_start"), F.max("ds").alias("test_end")
    )
    return train.join(test, [*keys, "cutoff"], "left").withColumn(
        "n_test", F.coalesce("n_test", F.lit(0).cast("long"))
    )


def monthly_folds(df: DataFrame, keys: list[str], t: str, fraction: float = 0.8) -> DataFrame:
    """Walk-forward folds, one per calendar month of the rows after the initial share.

    Training rows are all rows before the fold's first test row.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    pos = df.select(*keys, t).withColumns({
        "_pos": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
    })
    pool = pos.where(F.col("_pos") > F.floor(F.col("_n") * F.lit(fraction)))
    return _number_folds(pool, keys, t)


def folds_from(df: DataFrame, keys: list[str], t: str, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """Walk-forward monthly folds from a fixed date on, up to and with ``end``; a single month if both lie in it."""
    w = Window.partitionBy(*keys).orderBy(t)
    pos = df.select(*keys, t).withColumn("_pos", F.row_number().over(w))
    asked = F.col(t) >= F.lit(start)
    return _number_folds(pos.where(asked & (F.col(t) <= F.lit(end)) if end else asked), keys, t)


def _number_folds(pool: DataFrame, keys: list[str], t: str) -> DataFrame:
    months = pool.groupBy(*keys, month_start(t).alias("month")).agg(
        F.min(t).alias("test_start"), F.max(t).alias("test_end"),
        (F.min("_pos") - 1).cast("long").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
    )
    w = Window.partitionBy(*keys).orderBy("month")
    return months.withColumn("fold", F.row_number().over(w))


def pick_folds(cv: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    """Up to ``n`` evenly spaced cutoffs per station, earliest first."""
    w = Window.partitionBy(*keys)
    numbered = cv.select(*keys, "cutoff").distinct().withColumns({
        "_i": F.row_number().over(w.orderBy("cutoff")) - 1, "_n": F.count(F.lit(1)).over(w),
    })
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return numbered.where((F.col("_i") % step == 0) & (F.col("_i") / step < n)).select(*keys, "cutoff")
