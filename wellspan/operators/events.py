"""Run-theory events, heatwaves and compound months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.functions.dates import doy_ring, month_number, month_start
from wellspan.functions.stats import clip_low, round_half_even
from wellspan.operators.calendar import densify
from wellspan.operators.joins import compound_frame


def run_bounds(df: DataFrame, keys: list[str], t: str, flag: str) -> DataFrame:
    """First and last row of every run of a true flag."""
    w = Window.partitionBy(*keys).orderBy(t)
    prev = F.lag(flag, 1, False).over(w)
    nxt = F.lead(flag, 1, False).over(w)
    return df.withColumns({
        "run_start": F.col(flag) & ~prev, "run_end": F.col(flag) & ~nxt,
    })


def run_ids(df: DataFrame, keys: list[str], t: str, flag: str) -> DataFrame:
    """Run number and run length of equal consecutive flags."""
    w = Window.partitionBy(*keys).orderBy(t)
    changed = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True))
    numbered = df.withColumn("_chg", changed.cast("int")).withColumn("run_id", F.sum("_chg").over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "run_id"))
    return numbered.withColumn("run_size", size).drop("_chg")


def characterize_events(
    df: DataFrame, keys: list[str], t: str, value: str,
    threshold: float = -1.0, direction: str = "below", min_gap: int = 1, pooling: bool = True,
) -> DataFrame:
    """Threshold events of a monthly series.

    Each row carries the number of the latest event start, all from one window per station; the
    event table is then one aggregate on (station, event), which needs no further shuffle. Rows
    between two pooled runs count towards the duration, rows after the last hit do not.
    """
    v, thr = F.col(value), F.lit(float(threshold))
    if direction == "below":
        hit, excess, extreme, order = v < thr, thr - v, F.min, v
    elif direction == "above":
        hit, excess, extreme, order = v > thr, v - thr, F.max, -v
    else:
        raise ValueError(f"direction must be below or above, not {direction!r}")

    w = Window.partitionBy(*keys).orderBy(t)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(v.isNotNull()).select(*keys, t, value, hit.alias("_hit"))
    rows = rows.withColumns({
        "_row": F.row_number().over(w),
        "_prev": F.lag("_hit", 1, False).over(w),
        "_last_hit": F.last(F.when(F.col("_hit"), F.col(t)), ignorenulls=True).over(before),
    })
    begins = F.col("_hit") & ~F.col("_prev")
    if pooling:
        gap = month_number(t) - month_number("_last_hit")
        begins = begins & (F.col("_last_hit").isNull() | (gap > min_gap))
    rows = rows.withColumn("_event", F.sum(begins.cast("int")).over(w)).where(F.col("_event") > 0)

    at_hit = lambda c: F.when(F.col("_hit"), c)
    events = rows.groupBy(*keys, F.col("_event").alias("event_no")).agg(
        F.min(t).alias("start"),
        F.max(at_hit(F.col(t))).alias("end"),
        (F.max(at_hit(F.col("_row"))) - F.min("_row") + 1).alias("duration_m"),
        extreme(at_hit(v)).alias("_peak"),
        F.sum(at_hit(clip_low(excess))).alias("_severity"),
        F.min_by(t, at_hit(F.struct(order, t))).alias("peak_date"),
    )
    return events.select(
        *keys, "event_no", "start", "end", "duration_m",
        round_half_even(F.col("_peak"), 2).alias("peak"),
        round_half_even(F.col("_severity"), 2).alias("severity"),
        round_half_even(F.col("_severity") / F.col("duration_m"), 2).alias("mean_intensity"),
        "peak_date",
    )


def arg_extreme(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def event_extremes(events: DataFrame, by: list[str], direction: str = "below") -> DataFrame:
    """Longest and most intense event per group; the earliest one on ties. One aggregate."""
    rest = F.struct(*[c for c in events.columns if c not in by])
    peak = F.col("peak") if direction == "below" else -F.col("peak")
    picked = events.groupBy(*by).agg(
        F.min_by(rest, F.struct(-F.col("duration_m"), "start")).alias("longest"),
        F.min_by(rest, F.struct(peak, "start")).alias("most_intense"),
    )
    rows = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("_e")) for k in ("longest", "most_intense")]
    return picked.select(*by, F.inline(F.array(*rows))).select(*by, "kind", "_e.*")


def quantile_of_sorted(values: Column, q: float) -> Column:
    """Linear-interpolation quantile of a sorted array without NULLs."""
    h = (F.size(values) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    a, b = F.get(values, lo), F.get(values, F.least(lo + 1, F.size(values) - 1))
    return a + (b - a) * (h - lo)


def doy_percentile(df: DataFrame, keys: list[str], t: str, value: str, q: float = 0.9, half: int = 15) -> DataFrame:
    """Percentile of all days whose day-of-year lies within ``half`` days, per circle day.

    Values are gathered per (station, day-of-year) first, one per year, and only those short
    arrays are repeated around the circle; the daily rows themselves are never multiplied.
    """
    per_day = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.dayofyear(t).alias("_doy"))
        .agg(F.collect_list(value).alias("_vals"))
    )
    ring = per_day.select(*keys, "_vals", F.explode(doy_ring(F.col("_doy"), half)).alias("doy"))
    merged = ring.groupBy(*keys, "doy").agg(F.sort_array(F.flatten(F.collect_list("_vals"))).alias("_vals"))
    return merged.select(*keys, "doy", quantile_of_sorted(F.col("_vals"), q).alias("threshold"))


def heatwave_days(
    df: DataFrame, keys: list[str], t: str, value: str,
    pct: float = 0.9, half: int = 15, min_days: int = 3,
) -> DataFrame:
    """Days above their ring percentile that belong to a run of at least ``min_days`` days."""
    daily = densify(df.select(*keys, t, value), keys, t).withColumn("doy", F.dayofyear(t))
    thresholds = doy_percentile(df, keys, t, value, pct, half)
    hot = daily.join(thresholds, [*keys, "doy"], "left").withColumn(
        "hot", F.coalesce(F.col(value) > F.col("threshold"), F.lit(False))
    )
    runs = run_ids(hot, keys, t, "hot")
    return runs.select(
        *keys, t, value, "threshold", "hot",
        (F.col("hot") & (F.col("run_size") >= min_days)).alias("heatwave"),
    )


def heatwave_months(days: DataFrame, keys: list[str], t: str) -> DataFrame:
    return days.groupBy(*keys, month_start(t).alias("month")).agg(
        F.count_if("heatwave").alias("heatwave_days"), F.bool_or("heatwave").alias("heatwave")
    )


def compound_months(monthly_z: DataFrame, hw_months: DataFrame, keys: list[str], threshold: float = -1.0) -> DataFrame:
    """Months in drought and with heatwave days."""
    drought = monthly_z.select(
        *keys, "month", F.coalesce(F.col("z") < threshold, F.lit(False)).alias("drought")
    )
    both = compound_frame(drought, hw_months.select(*keys, "month", "heatwave"), [*keys, "month"])
    return both.withColumn("compound", F.col("drought") & F.col("heatwave"))


def crosstab(df: DataFrame, keys: list[str], a: str, b: str, values: list) -> DataFrame:
    """Contingency counts; the column values are given, so no pass is spent on finding them."""
    counts = [F.count_if(F.col(b) == v).alias(f"{b}_{str(v).lower()}") for v in values]
    return df.groupBy(*keys, a).agg(*counts)
