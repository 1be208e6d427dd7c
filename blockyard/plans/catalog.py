"""All registered queries (imports register them)."""

from blockyard.plans import (q_broker, q_io, q_joins, q_motion, q_scalars, q_stock, q_streams,  # noqa: F401
                             q_tracker)
from blockyard.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
