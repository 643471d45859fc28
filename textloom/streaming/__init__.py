"""Structured Streaming forms of serving and monitoring."""

from textloom.streaming.serving import (
    append_stream_metrics,
    read_latest,
    stream_metrics,
    stream_responses,
    write_latest,
    write_stream,
)
from textloom.streaming.stopping import stream_early_stop

__all__ = [
    "append_stream_metrics",
    "read_latest",
    "stream_early_stop",
    "stream_metrics",
    "stream_responses",
    "write_latest",
    "write_stream",
]
