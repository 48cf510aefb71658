"""Structured Streaming into an index."""

from vecpack.streaming.insert import insert_stream

__all__ = ["insert_stream"]
