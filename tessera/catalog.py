"""All queries of the entity-graph operators and their DuckDB statements."""

from tessera.queries import ORACLES, QUERIES
from tessera.queries import build, features, graph, io, network, raster  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
