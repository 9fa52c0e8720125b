from .csv_trips import append_all, month_of_path, month_paths, normalize_missing, read_trips
from .lineitem_trips import trips_from_lineitem
from .listing import SourceFile, headers, list_files

__all__ = ["SourceFile", "append_all", "headers", "list_files", "month_of_path", "month_paths", "normalize_missing", "read_trips", "trips_from_lineitem"]
