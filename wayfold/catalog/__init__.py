"""The registered queries, one per operator, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("basics", "relations", "profile", "scalars", "journey", "members", "modelling", "content")


def load_all() -> None:
    """Import every catalog module, which registers its queries."""
    for name in MODULES:
        import_module(f"wayfold.catalog.{name}")
