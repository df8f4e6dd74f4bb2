"""All registered queries."""

from importlib import import_module

from footlamp.catalog.registry import REGISTRY

AREAS = ["validation", "planning", "jobs", "telemetry", "frames", "filters", "audio", "spectrum", "live"]

for _area in AREAS:
    import_module(f"footlamp.catalog.{_area}")

__all__ = ["REGISTRY"]
