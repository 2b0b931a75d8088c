"""Queries over the driver's tables, each with its SQL."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Imports every module here, which registers its queries."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
