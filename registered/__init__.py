"""The queries that exercise every operator over the driver's tables."""

from . import files, links, quality, shape
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "files", "links", "quality", "shape"]
