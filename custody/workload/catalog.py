"""All registered queries."""

from custody.workload import (  # noqa: F401
    ledger_queries,
    report_queries,
    scalar_queries,
    stream_queries,
    tracker_queries,
    tree_queries,
)
from custody.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
