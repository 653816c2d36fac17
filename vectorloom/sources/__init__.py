"""Tensor files as Spark sources and sinks."""
