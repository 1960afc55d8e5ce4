"""A claim graph as walks read it: the claims by subject, and those between entities by object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import storage


@dataclass
class Graph:
    by_subject: DataFrame
    by_object: DataFrame
    #: What gives the claims at some nodes (column ``node``, written and distinct), where there is a way that needn't move all claims.
    at_subject: Callable[[DataFrame], DataFrame] | None = None
    at_object: Callable[[DataFrame], DataFrame] | None = None

    @staticmethod
    def of(claims: DataFrame | Graph) -> Graph:
        """The graph of a table of claims, which then serves both ways."""
        return claims if isinstance(claims, Graph) else Graph(claims, claims.where("object_kind = 'iri'"))

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Graph:
        """The graph with f, which looks at claims one by one or by id, applied to either side."""
        at = lambda near: None if near is None else lambda nodes: f(near(nodes))
        return Graph(f(self.by_subject), f(self.by_object), at(self.at_subject), at(self.at_object))

    def at_nodes(self, f: Callable[[DataFrame], DataFrame]) -> Graph:
        """As ``map``, for an f that writes what it is given: it gets the claims at the nodes alone, and the whole sides are empty."""
        none = f(self.by_subject.where(F.lit(False)))
        return Graph(none, none, lambda nodes: f(self.at_subject(nodes)), lambda nodes: f(self.at_object(nodes)))

    def nodes(self, frontier: DataFrame) -> DataFrame | None:
        """The distinct nodes of a frontier, written, where they are asked for."""
        return None if self.at_subject is None and self.at_object is None else storage.materialize(frontier.select("node").distinct(), "nodes")

    def outgoing(self, nodes: DataFrame | None) -> DataFrame:
        """Claims that hold all those with a subject among the nodes."""
        return self.by_subject if self.at_subject is None else self.at_subject(nodes)

    def incoming(self, nodes: DataFrame | None) -> DataFrame:
        """Claims that hold all those with an object among the nodes."""
        return self.by_object if self.at_object is None else self.at_object(nodes)
