"""siftwell: find out what is in a table before trusting it, on Spark."""

from .errors import Finding, Refused, Review, SpecError
from .session import build_session, workspace

__all__ = ["Finding", "Refused", "Review", "SpecError", "build_session", "workspace"]
