from . import charts, cleaning, measures, profile, quantiles, stations, summaries

__all__ = ["charts", "cleaning", "measures", "profile", "quantiles", "stations", "summaries"]
