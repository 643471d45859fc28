"""Text datasets on Spark: read, prepare, batch, score, generate, evaluate and monitor."""

from textloom.operators import *  # noqa: F403
from textloom.operators import __all__ as _operators
from textloom.sources import *  # noqa: F403
from textloom.sources import __all__ as _sources

__all__ = [*_operators, *_sources]
