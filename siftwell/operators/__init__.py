"""siftwell.operators."""
