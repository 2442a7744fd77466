"""Sinks for raw pages: one folder for each target, or a partitioned table."""

from .store import save_pages
from .table import read_table, write_table

__all__ = ["read_table", "save_pages", "write_table"]
