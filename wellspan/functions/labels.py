"""Threshold ladders that turn numbers into classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: (upper bound, bound is part of the class, label, colour); the last class is open
SEVERITY_LADDER = [
    (-2.0, True, "Extreme drought", "#67001f"),
    (-1.5, True, "Severe drought", "#b2182b"),
    (-1.0, True, "Moderate drought", "#ef8a62"),
    (1.0, False, "Normal", "#4d4d4d"),
    (1.5, False, "Moderately wet", "#67a9cf"),
    (2.0, False, "Very wet", "#2166ac"),
]
SEVERITY_TOP = ("Extremely wet", "#053061")
SKILL_LADDER = [(0.5, "strong"), (0.8, "useful"), (1.0, "weak")]
SKILL_TOP = "no better than the mean"
BLOWUP_LADDER = [(1.3, "errors uniform"), (1.8, "some large misses")]
BLOWUP_TOP = "dominated by big blow-ups"
CALIBRATION_TOLERANCE = 0.07


def _severity(z: Column, position: int) -> Column:
    ladder = F.when(z.isNull() | F.isnan(z), F.lit(None).cast("string"))
    for bound, inclusive, *names in SEVERITY_LADDER:
        ladder = ladder.when(z <= bound if inclusive else z < bound, F.lit(names[position]))
    return ladder.otherwise(F.lit(SEVERITY_TOP[position]))


def severity_label(z: Column) -> Column:
    return _severity(z, 0)


def severity_color(z: Column) -> Column:
    return _severity(z, 1)


def _below(x: Column, steps: list[tuple[float, str]], top: str) -> Column:
    ladder = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        ladder = ladder.when(x < bound, F.lit(name))
    return ladder.otherwise(F.lit(top))


def skill_label(rmse_ratio: Column) -> Column:
    """Reading of RMSE divided by the spread of the target."""
    return _below(rmse_ratio, SKILL_LADDER, SKILL_TOP)


def blowup_label(rmse_mae: Column) -> Column:
    """Reading of RMSE divided by MAE."""
    return _below(rmse_mae, BLOWUP_LADDER, BLOWUP_TOP)


def calibration_label(coverage: Column, target: float) -> Column:
    return (
        F.when(coverage.isNull(), F.lit(None).cast("string"))
        .when(F.abs(coverage - F.lit(target)) < CALIBRATION_TOLERANCE, F.lit("well calibrated"))
        .when(coverage < target, F.lit("overconfident"))
        .otherwise(F.lit("too vague"))
    )
