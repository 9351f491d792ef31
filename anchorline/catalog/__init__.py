"""The query catalog."""

from importlib import import_module

MODULES = ("anchors", "temporal", "validation", "ordering", "evaluation", "audits", "streams", "models")


def load():
    """All queries and their SQL statements."""
    for name in MODULES:
        import_module(f"anchorline.catalog.{name}")
    from anchorline.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
