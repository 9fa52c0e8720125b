"""Bike-share trip analytics on Spark."""

from .operators import charts, cleaning, measures, profile, quantiles, stations, summaries
from .plans import REPORTS, RideTables, write_map_tables
from .session import cluster_settings, local_session
from .sources import read_trips

__all__ = [
    "REPORTS",
    "RideTables",
    "charts",
    "cleaning",
    "cluster_settings",
    "local_session",
    "measures",
    "profile",
    "quantiles",
    "read_trips",
    "stations",
    "summaries",
    "write_map_tables",
]
