"""All registered queries."""

from ringweave.plans import q_graph, q_ingest, q_models, q_reports, q_stream  # noqa: F401
from ringweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
