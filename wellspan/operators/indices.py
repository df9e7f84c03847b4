"""Rank-based standardised indices and their daily and forecast forms."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from wellspan.functions.dates import days_in_month, month_start
from wellspan.functions.normal import with_norm_ppf
from wellspan.functions.stats import gringorten
from wellspan.operators.calendar import monthly
from wellspan.operators.clean import fill_mean
from wellspan.operators.joins import asof_month, broadcast_month
from wellspan.operators.rolling import rolling_mean, rolling_sum
from wellspan.schemas import MIN_FORECAST_DAYS, IndexSpec


def rank_avg(c: Column, partition: list[Column | str]) -> Column:
    """Average rank of non-NULL values: mean of the lowest and the highest rank of a tie.

    Both come from one ordered window (the default frame ends at the last peer), so ties need no
    second shuffle or sort.
    """
    w = Window.partitionBy(*partition).orderBy(c.asc_nulls_last())
    return F.when(c.isNotNull(), (F.rank().over(w) + F.count(c).over(w)) / F.lit(2.0))


TIE_PLACES = 8


def tie_key(c: Column | str) -> Column:
    """Value to rank by. Sums of doubles depend on the order of addition in their last bits, so
    values that differ only there count as tied, whatever the partitioning."""
    return F.round(c, TIE_PLACES)


def normal_score(df: DataFrame, value: str, partition: list[Column | str], out: str = "z") -> DataFrame:
    """Gringorten plotting position of each value in its group, through the inverse normal CDF."""
    n = F.count(value).over(Window.partitionBy(*partition))
    p = gringorten(rank_avg(tie_key(value), partition), n)
    return with_norm_ppf(df.withColumn("_p", p), "_p", out).drop("_p")


def accumulate(c: Column, scale: int, agg: Column, w: WindowSpec) -> Column:
    """Trailing accumulation over months: sum for fluxes, mean for states."""
    if scale == 1:
        return c
    return F.when(agg == "sum", rolling_sum(c, scale, w)).otherwise(rolling_mean(c, scale, w))


def standardized_index(
    df: DataFrame, keys: list[str], t: str, column: str, agg: str = "mean", scale: int = 1
) -> DataFrame:
    """Monthly standardised index of one daily column."""
    m = monthly(df, keys, t, {column: agg})
    w = Window.partitionBy(*keys).orderBy("month")
    acc = accumulate(F.col(column), scale, F.lit(agg), w)
    valued = m.select(*keys, "month", acc.alias("value"))
    return normal_score(valued, "value", [*keys, F.month("month")])


def melt_monthly(m: DataFrame, keys: list[str], specs: list[IndexSpec]) -> DataFrame:
    """Wide monthly aggregates to long rows (index, aggregate, value)."""
    rows = [
        F.struct(F.lit(s.name).alias("index_name"), F.lit(s.agg).alias("agg"), F.col(s.name).alias("m"))
        for s in specs
    ]
    return m.select(*keys, "month", F.inline(F.array(*rows)))


def index_panel(
    df: DataFrame, keys: list[str], t: str, specs: list[IndexSpec], scales: tuple[int, ...] = (1,)
) -> DataFrame:
    """All indices at all scales in long form.

    Daily rows are reduced to months once, for every index together; indices and scales are rows
    from there on, so a further index adds monthly rows and no further scan.
    """
    present = [F.col(s.column).alias(s.name) for s in specs]
    daily = df.select(*keys, t, *present)
    m = monthly(daily, keys, t, {s.name: s.agg for s in specs})
    long = melt_monthly(m, keys, specs)
    w = Window.partitionBy(*keys, "index_name").orderBy("month")
    scaled = [
        F.struct(F.lit(s).alias("scale"), accumulate(F.col("m"), s, F.col("agg"), w).alias("value"))
        for s in scales
    ]
    per_scale = long.withColumn("_s", F.array(*scaled)).select(
        *keys, "month", "index_name", F.inline("_s")
    )
    return normal_score(per_scale, "value", [*keys, "index_name", "scale", F.month("month")])


def pivot_panel(panel: DataFrame, keys: list[str], names: list[str], scale: int | None = None) -> DataFrame:
    """Wide view, one column per index (and per scale as ``NAME-s`` when no scale is chosen).

    The names are given, so no pass over the data is spent on finding them.
    """
    if scale is not None:
        panel = panel.where(F.col("scale") == scale)
    else:
        panel = panel.withColumn("index_name", F.concat_ws("-", "index_name", F.col("scale").cast("string")))
    cols = [F.max(F.when(F.col("index_name") == n, F.col("z"))).alias(n) for n in names]
    return panel.groupBy(*keys, "month").agg(*cols)


def attach_indices(df: DataFrame, panel_wide: DataFrame, keys: list[str], t: str, names: list[str]) -> DataFrame:
    """Monthly indices on every day of their month; missing ones take the station mean."""
    joined = broadcast_month(df, panel_wide.select(*keys, "month", *names), keys, t)
    return fill_mean(joined, keys, names)


def causal_index(daily: DataFrame, monthly_z: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Leak-free daily feature: the previous month's index, carried forward."""
    w = Window.partitionBy(*keys).orderBy("month")
    shifted = monthly_z.select(*keys, "month", F.lag("z").over(w).alias("z_prev"))
    return asof_month(daily, shifted, keys, t, ["z_prev"])


def pool_score(df: DataFrame, less: str, equal: str, pool: str, out: str = "z") -> DataFrame:
    """Score of one value against a pool, given how many members are below, equal and in total.

    The value joins the pool: its average rank is ``less + (equal + 2) / 2`` of ``pool + 1``.
    """
    rank = F.col(less) + (F.col(equal) + F.lit(2)) / F.lit(2.0)
    p = gringorten(rank, F.col(pool) + F.lit(1))
    return with_norm_ppf(df.withColumn("_p", p), "_p", out).drop("_p")


def forecast_index(
    obs: DataFrame, forecast: DataFrame, last_train: DataFrame, keys: list[str],
    min_days: int = MIN_FORECAST_DAYS,
) -> DataFrame:
    """Index of each month a forecast touches.

    ``obs``: keys, ``ds``, ``y``; ``forecast``: keys, ``ds``, ``yhat``; ``last_train``: keys,
    ``last_train``. A month with observed days is completed by forecast days, a forecast-only
    month needs more than ``min_days`` days. The pool is the same calendar month of other years,
    one value per year, gathered by a window.
    """
    seen = obs.where(F.col("y").isNotNull()).select(*keys, "ds", F.col("y").alias("v"), F.lit(0).alias("fc"))
    ahead = (
        forecast.join(last_train, keys)
        .where((F.col("ds") > F.col("last_train")) & F.col("yhat").isNotNull())
        .select(*keys, "ds", F.col("yhat").alias("v"), F.lit(1).alias("fc"))
    )
    by_month = (
        seen.unionByName(ahead)
        .groupBy(*keys, month_start("ds").alias("month"))
        .agg(
            F.avg("v").alias("mean_level"),
            F.avg(F.when(F.col("fc") == 0, F.col("v"))).alias("hist_mean"),
            F.count_if(F.col("fc") == 0).alias("obs_days"),
            F.count_if(F.col("fc") == 1).alias("fc_days"),
        )
    )
    same_month = Window.partitionBy(*keys, F.month("month"))
    member = F.when(F.col("hist_mean").isNotNull(), F.struct("month", F.col("hist_mean").alias("v")))
    touched = by_month.withColumn("_all", F.collect_list(member).over(same_month)).where(
        (F.col("fc_days") > 0) & ((F.col("obs_days") > 0) | (F.col("fc_days") > min_days))
    )
    pool = F.transform(F.filter("_all", lambda m: m["month"] != F.col("month")), lambda m: m["v"])
    scored = touched.withColumn("_others", pool).withColumns({
        "_less": F.size(F.filter("_others", lambda v: tie_key(v) < tie_key("mean_level"))),
        "_equal": F.size(F.filter("_others", lambda v: tie_key(v) == tie_key("mean_level"))),
        "_pool": F.size("_others"),
    })
    return pool_score(scored, "_less", "_equal", "_pool", "spli").select(
        *keys, "month", "spli", "mean_level", "obs_days", "fc_days",
        days_in_month("month").alias("days_in_month"),
        F.when(F.col("obs_days") > 0, F.lit("blended")).otherwise(F.lit("forecast-only")).alias("mode"),
    )


def index_checks(panel: DataFrame, keys: list[str], mean_tol: float = 0.15, lo: float = 0.8, hi: float = 1.2) -> DataFrame:
    """Standardisation check and worst month of each index and scale."""
    g = panel.groupBy(*keys, "index_name", "scale").agg(
        F.avg("z").alias("mean_z"),
        F.stddev_samp("z").alias("std_z"),
        F.min_by("month", F.when(F.col("z").isNotNull(), F.struct("z", "month"))).alias("worst_month"),
    )
    ok = (F.abs("mean_z") < mean_tol) & (F.col("std_z") > lo) & (F.col("std_z") < hi)
    return g.withColumn("ok", F.coalesce(ok, F.lit(False)))
