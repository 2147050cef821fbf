"""Event-time windows over streams: an extension, as the relational part has batch operators only."""

from tarn.streaming.windows import drain, session_counts, sliding_counts, tumbling_counts

__all__ = ["drain", "session_counts", "sliding_counts", "tumbling_counts"]
