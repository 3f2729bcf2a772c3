"""Named queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from rasterloom.plans.registry import ORACLES, QUERIES


def load_all() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod != "registry":
            importlib.import_module(f"{__name__}.{mod}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
