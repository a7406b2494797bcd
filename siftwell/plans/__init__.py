"""siftwell.plans."""
