"""Import every query module so the registry is complete."""

from quillframe.plans import (  # noqa: F401
    analytics_queries,
    contract_queries,
    metrics_queries,
    pipeline_queries,
    request_queries,
    sink_queries,
    stream_queries,
    text_queries,
)
from quillframe.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
