"""All registered queries."""

from wellspan.plans import (  # noqa: F401
    daily_queries, forecast_queries, index_queries, quality_queries, stream_queries,
)
from wellspan.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
