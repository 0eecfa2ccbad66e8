"""The query catalogue."""

from . import records, sounds, texts, timelines
from .fixtures import Tables
from .registry import CATALOG

__all__ = ["CATALOG", "Tables"]
