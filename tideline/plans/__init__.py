"""Queries over the test tables."""

from importlib import import_module

MODULES = ("core", "quality", "technical", "rules", "accounts", "searching", "resampling", "books", "learning", "exposures")


def load_all() -> None:
    from importlib.util import find_spec

    for name in MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
