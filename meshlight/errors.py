"""Errors that the graph operators raise."""

from __future__ import annotations


class GraphError(ValueError):
    """Base of all errors of this package."""


class DirectedNotSupported(GraphError):
    """Community detection needs an undirected graph."""


class EmptyGraph(GraphError):
    """Overlapping detection needs at least one node."""


class InvalidMergeOptions(GraphError):
    """A merge option lies outside its range."""


class PartitionGraphMismatch(GraphError):
    """A partition names a node that the graph does not have."""


class InvalidInput(GraphError):
    """Negative weights, or negative community ids."""
