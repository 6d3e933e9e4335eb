"""The registered queries."""

from phasemill.catalog import frames, lakes, projection, quality, rasters, refinement, regions, scalars, streams  # noqa: F401
from phasemill.catalog.registry import ORACLES, QUERIES  # noqa: F401
