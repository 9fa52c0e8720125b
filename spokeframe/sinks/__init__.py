from .csv_tables import ROW_NUMBER, write_csv, write_ranked_csv

__all__ = ["ROW_NUMBER", "write_csv", "write_ranked_csv"]
