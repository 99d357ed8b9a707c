"""Loads every query module so that the registry is complete."""

from __future__ import annotations

from runledger.plans import (  # noqa: F401
    activity_queries,
    alert_queries,
    checkpoint_queries,
    dataset_queries,
    integrity_queries,
    lifecycle_queries,
    metric_queries,
    source_queries,
    stream_queries,
    worker_queries,
)
from runledger.plans.registry import ORACLES, QUERIES  # noqa: F401
