"""Readers and writers."""

from textloom.sources.readers import load_data, read_csv, union_splits
from textloom.sources.prompts import read_prompts
from textloom.sources.sinks import append_metrics, materialise, params_long, read_metrics, write_results

__all__ = [
    "append_metrics",
    "load_data",
    "materialise",
    "params_long",
    "read_csv",
    "read_metrics",
    "read_prompts",
    "union_splits",
    "write_results",
]
