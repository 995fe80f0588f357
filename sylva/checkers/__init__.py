"""The checkers that come with the engine."""

from __future__ import annotations

from sylva.plans.checkers import Checker


def builtin() -> list[Checker]:
    """All of them, declarative ones first."""
    from sylva.checkers import rules, written

    return [*rules.RULES, *written.CHECKERS]
