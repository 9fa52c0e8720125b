from .calendar import parse_timestamp, seconds_between
from .geodesic import geodesic_km, metres_between
from .labels import legend_label, level_rank, percent_label, short_count, spaced, thousands
from .rounding import from_hundredths, hundredths, nearest, percent_of, round_half_even

__all__ = [
    "from_hundredths",
    "geodesic_km",
    "hundredths",
    "legend_label",
    "level_rank",
    "metres_between",
    "nearest",
    "parse_timestamp",
    "percent_label",
    "percent_of",
    "round_half_even",
    "seconds_between",
    "short_count",
    "spaced",
    "thousands",
]
