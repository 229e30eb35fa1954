"""DataFrame operators of the erasure engine."""
