"""All core queries; importing this module fills the registry."""

from skarn.plans import q_data, q_graph, q_metrics, q_more, q_text, q_tokens, q_vectors  # noqa: F401
from skarn.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
