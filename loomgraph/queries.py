"""All registered queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

import importlib
import pkgutil

from . import catalog
from .catalog.base import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(catalog.__path__)):
    importlib.import_module(f"{catalog.__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
