"""Operators on relations of pages: records, metadata, status checks, last write wins, integrity."""

from .records import integrity, last_write_wins, metadata, quarantined, raw_pages, report_lines, require_success, successful

__all__ = ["integrity", "last_write_wins", "metadata", "quarantined", "raw_pages", "report_lines", "require_success", "successful"]
