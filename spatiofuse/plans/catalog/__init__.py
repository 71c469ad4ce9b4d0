"""The registered queries and their reference SQL."""

from spatiofuse.plans.catalog import scans, skill, spatial  # noqa: F401
from spatiofuse.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
