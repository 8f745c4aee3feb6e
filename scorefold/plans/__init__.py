"""Registered queries: each module binds operators to the given tables and states the same result in SQL."""

from __future__ import annotations

import importlib

MODULES = ["panel", "facts", "cohort", "text", "audit", "scores", "retrieve", "calibration", "resample", "frames", "trained", "sources"]


def load_all() -> None:
    """Import every query module once, which fills the registry."""
    for m in MODULES:
        importlib.import_module(f"scorefold.plans.{m}")
