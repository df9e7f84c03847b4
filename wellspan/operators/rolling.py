"""Rolling windows, lags and water-balance features."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from wellspan.functions.stats import round_half_even
from wellspan.operators.calendar import densify
from wellspan.operators.clean import fill_first_valid


def _full(agg: Column, c: Column, n: int, frame: WindowSpec) -> Column:
    return F.when(F.count(c).over(frame) == n, agg.over(frame))


def rolling_sum(c: Column, n: int, w: WindowSpec) -> Column:
    """Sum over the last ``n`` rows, NULL until ``n`` values are in the frame."""
    return _full(F.sum(c), c, n, w.rowsBetween(1 - n, 0))


def rolling_mean(c: Column, n: int, w: WindowSpec, places: int | None = None) -> Column:
    mean = _full(F.avg(c), c, n, w.rowsBetween(1 - n, 0))
    return mean if places is None else round_half_even(mean, places)


def rolling_centered(c: Column, n: int, w: WindowSpec) -> Column:
    """Centred mean; an even window takes its extra row on the left."""
    return _full(F.avg(c), c, n, w.rowsBetween(-(n // 2), n - 1 - n // 2))


def _factors(n: int) -> list[int]:
    out, p = [], 2
    while n > 1:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out


def rolling_sums(
    df: DataFrame, keys: list[str], t: str, values: dict[str, Column], windows: tuple[int, ...]
) -> DataFrame:
    """``<name>_<n>``: the same as :func:`rolling_sum`, built from shorter sums.

    A sum over ``m * p`` rows is ``p`` sums over ``m`` rows taken ``m`` rows apart, so 30 rows take
    steps of 2, 3 and 5, and 90 rows one more step of 3: a few look-backs per row in place of a
    walk over each frame. Nothing is subtracted, so a dry spell sums to exactly zero, and a missing
    value makes every frame over it NULL by itself.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    out = df.withColumns({f"_s_{name}": c.cast("double") for name, c in values.items()})
    reached = 1
    for n in sorted(windows):
        if n % reached:
            out = out.withColumns({f"_s_{name}": c.cast("double") for name, c in values.items()})
            reached = 1
        for p in _factors(n // reached):
            out = out.withColumns({
                f"_s_{name}": reduce(add, [F.lag(f"_s_{name}", j * reached).over(w) for j in range(1, p)], F.col(f"_s_{name}"))
                for name in values
            })
            reached *= p
        out = out.withColumns({f"{name}_{n}": F.col(f"_s_{name}") for name in values})
    return out.drop(*[f"_s_{name}" for name in values])


def frame_sums(
    df: DataFrame, keys: list[str], t: str, values: dict[str, Column], before: int, after: int
) -> DataFrame:
    """Sums over ``before`` rows back to ``after`` rows ahead, cut at the station's ends.

    Differences of running sums: the cost of a row does not depend on the width of the frame, which
    a sliding frame of a year would multiply by 365. Values should be centred near zero, so that
    the running sums stay small.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    whole = Window.partitionBy(*keys)
    growing = w.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    parts = {name: F.coalesce(c.cast("double"), zero) for name, c in values.items()}
    out = df.withColumns({f"_c_{name}": F.sum(c).over(growing) for name, c in parts.items()})
    out = out.withColumns({f"_a_{name}": F.sum(c).over(whole) for name, c in parts.items()})
    sums = {}
    for name in values:
        upper = F.coalesce(F.lead(f"_c_{name}", after).over(w), F.col(f"_a_{name}"))
        lower = F.coalesce(F.lag(f"_c_{name}", before + 1).over(w), zero)
        sums[name] = upper - lower
    return out.withColumns(sums).drop(*[f"_{x}_{name}" for name in values for x in "ca"])


def with_centered_mean(df: DataFrame, keys: list[str], t: str, column: str, n: int, out: str) -> DataFrame:
    """:func:`rolling_centered` for wide windows, by running sums of the distance from the mean."""
    base = df.withColumn("_base", F.avg(column).over(Window.partitionBy(*keys)))
    values = {
        "_sum": F.col(column) - F.col("_base"), "_cnt": F.col(column).isNotNull().cast("double"),
    }
    rows = frame_sums(base, keys, t, values, n // 2, n - 1 - n // 2)
    mean = F.col("_sum") / F.lit(float(n)) + F.col("_base")
    return rows.withColumn(out, F.when(F.col("_cnt") == n, mean)).drop("_base", "_sum", "_cnt")


def water_balance_features(
    df: DataFrame, keys: list[str], t: str, rain: str, et0: str, temperature: str,
    windows: tuple[int, ...] = (30, 90),
) -> DataFrame:
    """Cumulative rain, cumulative effective rain and mean temperature, first-valid filled.

    All features share one partitioning and sort, the fill included.
    """
    values = {"_p": F.col(rain), "_e": F.col(rain) - F.col(et0), "_t": F.col(temperature)}
    sums = rolling_sums(df, keys, t, values, windows)
    features: dict[str, Column] = {}
    for n in windows:
        features[f"P_cum_{n}d"] = F.col(f"_p_{n}")
        features[f"Peff_cum_{n}d"] = F.col(f"_e_{n}")
        features[f"Temperature_mean_{n}d"] = round_half_even(F.col(f"_t_{n}") / F.lit(float(n)), 2)
    helpers = [f"{name}_{n}" for name in values for n in windows]
    return fill_first_valid(sums.withColumns(features).drop(*helpers), keys, t, list(features))


def lag_features(df: DataFrame, keys: list[str], t: str, columns: list[str], h: int) -> DataFrame:
    """``<column>_lag<h>`` by position; densify first when the lag must be calendar days."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumns({f"{c}_lag{h}": F.lag(c, h).over(w) for c in columns})


def lead_targets(df: DataFrame, keys: list[str], t: str, column: str, steps: list[int], suffix: str = "m") -> DataFrame:
    """``<column>_<i><suffix>``: the value ``i`` rows ahead."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.withColumns({f"{column}_{i}{suffix}": F.lead(column, i).over(w) for i in steps})


def extend_and_lag(
    df: DataFrame, keys: list[str], t: str, columns: list[str], h: int, freq: str = "day"
) -> DataFrame:
    """Calendar extended by ``h`` periods with the regressors lagged by ``h`` periods."""
    return lag_features(densify(df, keys, t, freq, extra=h), keys, t, columns, h)
