"""Column-level building blocks; everything here stays inside the JVM."""

from wellspan.functions.dates import (
    as_date, days_in_month, doy_ring, month_number, month_start,
)
from wellspan.functions.labels import (
    blowup_label, calibration_label, severity_color, severity_label, skill_label,
)
from wellspan.functions.normal import norm_ppf, with_norm_ppf
from wellspan.functions.stats import (
    clip_low, corr_safe, finite, gringorten, mape, r_squared, ratio, rmse, round_half_even,
)
from wellspan.functions.text import join_list_text, safe_name, typed_params

__all__ = [
    "as_date", "blowup_label", "calibration_label", "clip_low", "corr_safe", "days_in_month",
    "doy_ring", "finite", "gringorten", "join_list_text", "mape", "month_number", "month_start",
    "norm_ppf", "r_squared", "ratio", "rmse", "round_half_even", "safe_name", "severity_color",
    "severity_label", "skill_label", "typed_params", "with_norm_ppf",
]
