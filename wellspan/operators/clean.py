"""Cleaning, de-duplication, schema checks and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wellspan import schemas
from wellspan.functions.dates import day_of
from wellspan.operators.calendar import densify


def clean_obs(df: DataFrame) -> DataFrame:
    """Observation table ready to join: day index, quality-control columns removed."""
    return df.withColumn(schemas.DATE_INDEX, day_of(df, "date_mesure")).drop(*schemas.OBSERVATION_DROP)


def clean_weather(df: DataFrame) -> DataFrame:
    """Weather table ready to join: sparse and collinear columns removed."""
    return df.withColumn(schemas.DATE_INDEX, day_of(df, "date")).drop(
        *schemas.WEATHER_DROP_SPARSE, *schemas.WEATHER_DROP_COLLINEAR
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value past this point."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def numeric_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_regex(df: DataFrame, pattern: str = "^S.*I$") -> DataFrame:
    return df.select(df.colRegex(f"`{pattern}`"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise before any job runs when a needed column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def present_missing(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    have = set(df.columns)
    return [c for c in columns if c in have], [c for c in columns if c not in have]


def column_contract(tables: dict[str, tuple[DataFrame, T.StructType]], spark: SparkSession) -> DataFrame:
    """What is there and what isn't, for each table and the columns it should have; reads metadata only.

    One row for each expected or found column: ``status`` is ``present``, ``missing``, ``wrong type`` or
    ``not asked for``.
    """
    rows = []
    for name, (df, wanted) in tables.items():
        found = {f.name: f.dataType.simpleString() for f in df.schema}
        present, missing = present_missing(df, wanted.names)
        for c in present:
            kind = wanted[c].dataType.simpleString()
            rows.append((name, c, kind, found[c], "present" if kind == found[c] else "wrong type"))
        rows += [(name, c, wanted[c].dataType.simpleString(), None, "missing") for c in missing]
        rows += [(name, c, None, kind, "not asked for") for c, kind in found.items() if c not in wanted.names]
    return spark.createDataFrame(rows, "table_name string, column_name string, expected string, found string, status string")


def between_dates(df: DataFrame, t: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows in a closed date range; plain comparisons, so they reach the scan."""
    if first is not None:
        df = df.where(F.col(t) >= first)
    if last is not None:
        df = df.where(F.col(t) <= last)
    return df


def with_water_balance(df: DataFrame, rain: str, et0: str, out: str = "Peff") -> DataFrame:
    return df.withColumn(out, F.col(rain) - F.col(et0))


def sortable(df: DataFrame, exclude: list[str] = ()) -> list[str]:
    """Columns that have an order, by name."""
    return sorted(f.name for f in df.schema if f.name not in exclude and not isinstance(f.dataType, (T.MapType, T.VariantType)))


def _pick(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key. An aggregate, not a window: repeats collapse before the shuffle."""
    return _pick(df, keys, [F.col(c) for c in order], F.min_by)


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key, by the same partial aggregation."""
    return _pick(df, keys, [F.col(c) for c in order], F.max_by)


def upsert_last(history: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """History merged with a new delivery; on equal keys the new row wins.

    ``order`` names the columns that decide between rows of one delivery, the last one wins. Without
    it all other columns do, so the result doesn't depend on how the rows are partitioned.
    """
    both = history.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    rest = order if order is not None else sortable(both, [*keys, "_batch"])
    return dedupe_last(both, keys, ["_batch", *rest]).drop("_batch")


def daily_mean(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """One row per station and day: mean of each column."""
    require_columns(df, [*keys, t, *columns])
    return df.groupBy(*keys, t).agg(*[F.avg(c).alias(c) for c in columns])


def fill_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """NULLs replaced by the station's column mean."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in columns})


def forward_fill(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_first_valid(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Every NULL of a column takes the station's earliest value."""
    w = Window.partitionBy(*keys)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(t))).over(w))
        for c in columns
    })


def interpolate_linear(df: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Straight line over days between known values.

    Values before the first known one stay NULL, values after the last one repeat it. The next
    known value comes from a second, descending pass with the same growing frame: linear time per
    station, where a frame open to the future would be quadratic.
    """
    back = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = {f"_k_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(t).alias("d"), F.col(c).alias("v"))) for c in columns}
    out = df.withColumns(known)
    out = out.withColumns({f"_p_{c}": F.last(f"_k_{c}", ignorenulls=True).over(back) for c in columns})
    out = out.withColumns({f"_n_{c}": F.last(f"_k_{c}", ignorenulls=True).over(ahead) for c in columns})
    filled = {}
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        slope = F.try_divide(n["v"] - p["v"], F.date_diff(n["d"], p["d"]))
        line = slope * F.date_diff(F.col(t), p["d"]) + p["v"]
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(p.isNull(), F.lit(None).cast("double"))
            .when(n.isNull(), p["v"])
            .otherwise(line)
        )
    helpers = [f"_{x}_{c}" for c in columns for x in "kpn"]
    return out.withColumns(filled).drop(*helpers)


def conform_daily(
    df: DataFrame,
    keys: list[str],
    t: str,
    columns: list[str] | None = None,
    order: list[str] | None = None,
    keep_gap_days: bool = False,
) -> DataFrame:
    """De-duplicate by day and interpolate numeric columns over the calendar.

    Interpolation uses day distance, so the calendar spine is only needed when the gap days
    themselves are wanted in the output. There is one row per station and day in any case:
    the first reading by ``order``, the delivery order; without it, readings with fewer missing
    values come first, then those with smaller values.
    """
    cols = columns or numeric_columns(df, exclude=[*keys, *(order or [])])
    if order:
        df = dedupe_first(df, [*keys, t], order)
    else:
        rest = sortable(df, [*keys, t])
        gaps = sum((F.col(c).isNull().cast("int") for c in rest), F.lit(0))
        df = dedupe_first(df.withColumn("_gaps", gaps), [*keys, t], ["_gaps", *rest]).drop("_gaps")
    if keep_gap_days:
        df = densify(df, keys, t)
    return interpolate_linear(df, keys, t, cols)
