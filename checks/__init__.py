"""Driver queries with their SQL counterparts, grouped like the operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["profile_checks", "prepare_checks", "evaluation_checks", "model_checks"]


def all_checks() -> dict:
    """Query name to ``(callable, SQL or None)``."""
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"checks.{name}").CHECKS
    return out
