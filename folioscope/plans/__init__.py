"""Composed queries and their oracle SQL."""

from folioscope.plans import composites, distributions, flows_time, networks, places_graphs, texts_vectors, views
from folioscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composites", "distributions", "flows_time", "networks", "places_graphs", "texts_vectors", "views"]
