"""All queries of the core."""

from gleanery.plans import capture, catalog, closure, desk, events, graph, index, references, text, upkeep  # noqa: F401
from gleanery.plans.registry import QUERIES, SQL  # noqa: F401
