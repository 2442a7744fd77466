"""Raw pages as a stream: the same projections, applied to files as they arrive."""

from .pages import metadata_stream

__all__ = ["metadata_stream"]
