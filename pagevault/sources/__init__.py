"""Sources of raw pages: HTTP, a table that stands in for it, and the raw store."""

from .http import HttpPages, fetch_pages
from .store import read_bodies, read_metadata, read_metadata_files, read_store
from .table import targets, through_table

__all__ = ["HttpPages", "fetch_pages", "read_bodies", "read_metadata", "read_metadata_files", "read_store", "targets", "through_table"]
