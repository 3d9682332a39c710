"""All queries of the library outside llm."""

from . import camera_queries, match_queries, raster_queries, scalar_queries, source_queries, spatial_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
