"""Structured Streaming: stateful concat, fan-out with commits, metrics."""
