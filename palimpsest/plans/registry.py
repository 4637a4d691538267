"""The engine's queries, by the names that the entry module registers, and their SQL counterparts."""

from palimpsest.plans.queries import ORACLES, QUERIES

FLAGSHIP = "latest_token_origins"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
