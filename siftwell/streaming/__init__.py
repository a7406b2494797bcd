"""siftwell.streaming."""
