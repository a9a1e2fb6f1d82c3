"""Log lines as a stream."""

from logweave.streaming.stream import read_line_stream, require_batch, stream_to

__all__ = ["read_line_stream", "require_batch", "stream_to"]
