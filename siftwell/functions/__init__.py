"""siftwell.functions."""
