"""DataFrame to DataFrame operators on records; all but streaming ones run in batch and in streams."""
