"""All registered queries."""

from cyclewise.plans import q_batch, q_evaluate, q_fleet, q_io, q_model, q_monitor, q_stream, q_windows  # noqa: F401
from cyclewise.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
