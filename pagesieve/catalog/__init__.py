"""Registered queries by subject. ``load`` imports every module once."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
