"""All registered queries; importing the package fills the registry."""

from importlib import import_module

MODULES = ("spans", "sketches", "logs", "issues", "monitoring", "usage", "dimensions", "payloads", "privacy", "storage", "streams")

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

from .registry import QUERIES  # noqa: E402,F401
