"""Named queries grouped by family."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module so that the registry is complete."""
    for m in iter_modules(__path__):
        if m.name.startswith("q_"):
            import_module(f"{__name__}.{m.name}")
