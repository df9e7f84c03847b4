"""Calendar spines, gaps and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wellspan.functions.dates import month_start

STEP = {"day": "interval 1 day", "month": "interval 1 month"}


def _shift(c, n: int, freq: str):
    return F.add_months(c, n) if freq == "month" else F.date_add(c, n)


def densify(df: DataFrame, keys: list[str], t: str, freq: str = "day", extra: int = 0) -> DataFrame:
    """Reindex to the full calendar of each station, plus ``extra`` periods after its last row.

    Each row is followed by the empty periods up to the next row, so the calendar costs one
    window and no second pass over the input, as a separate spine to join with would.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    last = F.coalesce(_shift(F.lead(t).over(w), -1, freq), _shift(F.col(t), extra, freq))
    until = F.greatest(last, F.col(t))
    rest = [c for c in df.columns if c not in (*keys, t)]
    spread = df.withColumn("_until", until).select(
        *keys, F.col(t).alias("_t"), *rest, F.explode(F.sequence(t, "_until", F.expr(STEP[freq]))).alias(t)
    )
    own = F.col(t) == F.col("_t")
    return spread.select(*keys, t, *[F.when(own, F.col(c)).alias(c) for c in rest])


def spine(df: DataFrame, keys: list[str], t: str, freq: str = "day", extra: int = 0) -> DataFrame:
    """Every period from the first to the last one of each station, plus ``extra`` periods."""
    if freq == "month":
        df = df.select(*keys, month_start(t).alias(t))
    return densify(df.select(*keys, t).distinct(), keys, t, freq, extra)


def missing_dates(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Calendar days of each station's span that carry no row: the days between neighbours."""
    w = Window.partitionBy(*keys).orderBy(t)
    gaps = df.select(*keys, t).distinct().withColumn("_next", F.lead(t).over(w))
    gaps = gaps.where(F.date_diff("_next", F.col(t)) > 1)
    days = F.sequence(F.date_add(t, 1), F.date_sub("_next", 1))
    return gaps.select(*keys, F.explode(days).alias(t))


def calendar_difference(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The same days as :func:`missing_dates`, as a set difference."""
    return spine(df, keys, t).exceptAll(df.select(*keys, t).distinct())


def monthly_aggregate(df: DataFrame, keys: list[str], t: str, how: dict[str, str]) -> DataFrame:
    """Month-start rows with sum / mean / last per column; only months that have rows.

    A sum without any value is 0, a mean or last without any value is NULL.
    """
    aggs = []
    for column, kind in how.items():
        c = F.col(column)
        if kind == "sum":
            aggs.append(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(column))
        elif kind == "mean":
            aggs.append(F.avg(c).alias(column))
        elif kind == "last":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col(t))).alias(column))
        else:
            raise ValueError(f"unknown aggregate {kind!r}")
    return df.groupBy(*keys, month_start(t).alias("month")).agg(*aggs)


def monthly(df: DataFrame, keys: list[str], t: str, how: dict[str, str]) -> DataFrame:
    """Monthly resample with empty months kept inside each station's span."""
    rows = monthly_aggregate(df, keys, t, how)
    full = densify(rows, keys, "month", "month")
    sums = {c: F.coalesce(F.col(c), F.lit(0.0)) for c, kind in how.items() if kind == "sum"}
    return full.withColumns(sums) if sums else full


def gap_days(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Days since the previous row of the station."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumn("gap_days", F.date_diff(F.col(t), F.lag(t).over(w)))


def gap_stats(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    return gap_days(df.select(*keys, t), keys, t).groupBy(*keys).agg(
        F.min("gap_days").alias("min_gap"), F.max("gap_days").alias("max_gap")
    )


def split_tail(
    df: DataFrame, keys: list[str], t: str, skip: int, take: int | None = None, purge: int = 0
) -> DataFrame:
    """Tag rows by position from the end: all but the last ``skip`` are ``train``.

    ``take`` limits the test rows to the first ``take`` of that tail; ``purge`` leaves out that
    many training rows next to it.
    """
    w = Window.partitionBy(*keys)
    tagged = df.withColumns({
        "_pos": F.row_number().over(w.orderBy(t)), "_n": F.count(F.lit(1)).over(w),
    })
    edge = F.col("_n") - skip
    last_test = F.col("_n") if take is None else edge + take
    split = F.when(F.col("_pos") <= edge - purge, F.lit("train")).when(
        (F.col("_pos") > edge) & (F.col("_pos") <= last_test), F.lit("test")
    )
    return tagged.withColumn("split", split).where(F.col("split").isNotNull()).drop("_pos", "_n")
