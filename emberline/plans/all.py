"""All queries of the library."""

from emberline.plans import grids, hotspots, scenes, seasons, statistics  # noqa: F401
from emberline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
