from .catalog import QUERIES, REPORTS, write_map_tables
from .tables import RideTables

__all__ = ["QUERIES", "REPORTS", "RideTables", "write_map_tables"]
