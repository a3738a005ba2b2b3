"""Registered queries over the generated tables, with their SQL twins."""

from . import annotation, composition, counts, files, graph, sets, statistics, verbs
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotation", "composition", "counts", "files", "graph", "sets", "statistics", "verbs"]
