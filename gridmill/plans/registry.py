"""Every registered query of the grid engine with its SQL counterpart."""

from __future__ import annotations

from . import colour_queries, field_queries, particle_queries, spatial_queries

QUERIES = particle_queries.QUERIES | field_queries.QUERIES | colour_queries.QUERIES | spatial_queries.QUERIES
ORACLES = particle_queries.ORACLES | field_queries.ORACLES | colour_queries.ORACLES | spatial_queries.ORACLES
