"""All registered queries."""
from panelrisk.plans import (  # noqa: F401
    check_queries,
    climate_queries,
    eda_queries,
    metric_queries,
    model_queries,
    panel_queries,
    source_queries,
)
from panelrisk.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
