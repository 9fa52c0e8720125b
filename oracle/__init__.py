from .reports import REPORTS

__all__ = ["REPORTS"]
