"""All named queries and their SQL, from the modules that register them."""

from quillstream.plans import agents, arrays, costs, frames, measures, records, rollout, streams, tables, texts, verifying  # noqa: F401
from quillstream.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
