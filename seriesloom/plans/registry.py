"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from seriesloom.plans import augment_queries, branch_queries, candidate_queries, decoder_queries, geometry_queries, integrity_queries, lattice_queries, model_queries, overlap_queries, path_queries, relational_queries, series_queries, shape_queries, stats_queries, stream_queries, support_queries
from seriesloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "augment_queries", "branch_queries", "candidate_queries", "decoder_queries", "geometry_queries", "integrity_queries", "lattice_queries", "model_queries", "overlap_queries", "path_queries", "relational_queries", "series_queries", "shape_queries", "stats_queries", "stream_queries", "support_queries"]
