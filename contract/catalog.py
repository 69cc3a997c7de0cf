"""Imports every query module so that the registry is complete."""

from contract import landing_queries, live_queries, rating_queries, season_queries, shot_queries, stint_queries  # noqa: F401
from contract.registry import ORACLES, QUERIES  # noqa: F401
