"""Import every module that registers queries; exposes the full registry."""

from wardline.plans import (  # noqa: F401  (registration side effects)
    catalog, clean_queries, forecast_queries, ml_queries, model_queries, reports, search_queries, series_queries,
)
from wardline.plans.catalog import REGISTRY

__all__ = ["REGISTRY"]
