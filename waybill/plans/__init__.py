"""Registered queries and composed jobs."""

from waybill.plans import (  # noqa: F401
    registered,
    registered_metrics,
    registered_models,
    registered_privacy,
    registered_sources,
)
from waybill.plans.registered import QUERIES

__all__ = ["QUERIES"]
