"""Streaming use of the row-local operators and fitted models (no stateful operators:
the reference has none)."""

from .score import read_stream, score_stream, write_stream  # noqa: F401
