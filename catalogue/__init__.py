"""The registered queries: each runs a tablescope operator over whole tables,
most with an independent SQL statement that computes the same result."""

from catalogue.registry import REGISTRY, Tables  # noqa: F401
from catalogue import describe, maps, models, plans, profile, quality, questions, relations, series  # noqa: F401,E402
