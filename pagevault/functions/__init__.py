"""Column functions: hashes, sizes, headers, timestamps as text, JSON, storage paths."""

from .columns import digest, header, iso_utc, lower_headers, metadata_json, metadata_line, parse_metadata, size_bytes, store_path

__all__ = ["digest", "header", "iso_utc", "lower_headers", "metadata_json", "metadata_line", "parse_metadata", "size_bytes", "store_path"]
