"""All registered queries of the engine, and their SQL."""

from kinetia.plans import audit_queries, track_queries, tracker_queries
from kinetia.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "track_queries", "tracker_queries"]
