"""Registered queries of the core."""

from __future__ import annotations

import importlib

#: Modules that register queries.
MODULES = ("checks", "domain", "series", "text", "times")


def load_core():
    for m in MODULES:
        importlib.import_module(f"fathomline.plans.{m}")
    from fathomline.plans.registry import core

    return core
