"""Text and parameter-map helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wellspan.schemas import BOOL_PARAMS, FLOAT_PARAMS, TEXT_PARAMS


def join_list_text(c: Column) -> Column:
    """``"['A','B']"`` becomes ``"A, B"``; text that is no list literal stays as it is."""
    is_list = F.trim(c).rlike(r"^\[.*\]$")
    parsed = F.from_json(F.when(is_list, F.replace(c, F.lit("'"), F.lit('"'))), "array<string>")
    return F.coalesce(F.array_join(parsed, ", "), c)


def safe_name(c: Column) -> Column:
    """Station code usable in a file name."""
    return F.replace(c, F.lit("/"), F.lit(""))


def typed_params(params: Column) -> Column:
    """String parameter map to a typed struct; keys outside the allow-list are dropped."""
    fields = [F.element_at(params, F.lit(k)).try_cast("double").alias(k) for k in FLOAT_PARAMS]
    fields += [(F.lower(F.element_at(params, F.lit(k))) == "true").alias(k) for k in BOOL_PARAMS]
    fields += [F.element_at(params, F.lit(k)).alias(k) for k in TEXT_PARAMS]
    return F.struct(*fields)
