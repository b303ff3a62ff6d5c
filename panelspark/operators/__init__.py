"""Warehouse layers. Importing them registers their tables."""

from importlib import import_module

_LAYERS = (
    "staging",
    "dimensions",
    "facts",
    "marts",
    "quality",
    "analysis",
    "findings",
    "statistics",
    "measures",
    "exports",
    "snapshots",
    "profiles",
)


def load_all() -> None:
    for layer in _LAYERS:
        import_module(f"panelspark.operators.{layer}")
