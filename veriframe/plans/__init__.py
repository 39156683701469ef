"""Registered queries over the driver tables, one module per operator group."""

from importlib import import_module

MODULES = ["text", "dedup", "raters", "joins", "tables", "versions", "sources"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
