"""Errors and reviews shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

# Review levels, most serious first.
LEVELS = ("deny", "block", "warn")


class SpecError(ValueError):
    """A request that cannot be turned into a query."""


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    title: str
    detail: str = ""
    suggestions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Review:
    """What was measured before a run, and whether the run may go ahead.

    ``block`` can be confirmed by the caller, ``deny`` cannot.
    """

    findings: tuple[Finding, ...] = ()
    estimated_rows: int = 0
    steps: tuple = field(default=())

    @property
    def verdict(self) -> str:
        seen = {f.severity for f in self.findings}
        return next((level for level in LEVELS if level in seen), "allow")

    @property
    def overridable(self) -> bool:
        return self.verdict == "block"

    def enforce(self, confirm: bool = False) -> "Review":
        if self.verdict == "deny" or (self.overridable and not confirm):
            raise Refused(self)
        return self


class Refused(RuntimeError):
    """Carries the review that stopped a run."""

    def __init__(self, review: Review):
        super().__init__("; ".join(f.title for f in review.findings) or "refused")
        self.review = review
