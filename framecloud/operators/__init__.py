"""DataFrame operators on frames, pixels and points."""
