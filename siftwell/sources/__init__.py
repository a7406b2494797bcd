"""siftwell.sources."""
