"""Windows over events, in batch and as streams. The graph has no streams; this is beside it."""
