"""Loads every query module, so that the registry is complete."""

from sparkwarden.plans import (  # noqa: F401
    queries_dependencies,
    queries_discovery,
    queries_findings,
    queries_provenance,
    queries_secrets,
    queries_streaming,
)
from sparkwarden.plans.registry import ORACLES, QUERIES  # noqa: F401
