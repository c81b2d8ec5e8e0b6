"""Shortest-path trees kept as a table, one for each origin asked for, of one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshroute.operators import paths, relax
from meshroute.operators.model import Graph, check_ids
from meshroute.session import cut

SCHEMA = "origin_id long, node long, dist double, pred long"


class TreeCache:
    def __init__(self, graph: Graph):
        self.graph = self._of = graph
        self._trees: DataFrame | None = None

    def of(self, graph: Graph) -> TreeCache:
        """This cache, if its trees are the graph's; after any change a new one: a graph is immutable, so that its trees hold
        for that very graph only."""
        return self if graph is self._of else TreeCache(graph)

    def reset(self) -> None:
        self._trees = None

    def get(self) -> DataFrame:
        return self._trees if self._trees is not None else self.graph.spark.createDataFrame([], SCHEMA)

    def set(self, trees: DataFrame) -> None:
        """Takes a table of trees; its columns and its nodes are checked."""
        if set(trees.columns) != {"origin_id", "node", "dist", "pred"}:
            raise ValueError(f"columns {trees.columns} are not those of trees")
        if trees.join(self.graph.nodes.select("node_id"), F.col("node") == F.col("node_id"), "left_anti").limit(1).count():
            raise ValueError("the trees have nodes that the graph lacks")
        self._trees = trees

    def ensure(self, origins: DataFrame) -> DataFrame:
        """The trees of these origins (origin_id), computing those that are missing. Another graph has other trees."""
        if self.graph is not self._of:
            self.reset()
            self._of = self.graph
        have = self.get().select(F.col("origin_id").alias("h_origin")).distinct()
        new = cut(origins.select("origin_id").distinct().join(have, F.col("origin_id") == F.col("h_origin"), "left_anti"))
        if new.limit(1).count():
            dist = cut(relax.trees(self.graph.edges, relax.seeds_of(new)))
            tree = relax.predecessors(self.graph.edges, dist, new.select("origin_id", F.col("origin_id").alias("node")))
            self._trees = cut(self.get().unionByName(tree))
        return self.get().join(origins.select(F.col("origin_id").alias("w_origin")).distinct(), F.col("origin_id") == F.col("w_origin"), "left_semi")

    def shortest_paths(self, pairs: DataFrame, length_only: bool = False) -> DataFrame:
        check_ids(self.graph.nodes, pairs)
        tree = self.ensure(pairs.select("origin_id"))
        if not length_only:
            return paths.tree_paths(tree, pairs)
        d = tree.select(F.col("origin_id").alias("d_origin"), F.col("node").alias("d_node"), F.col("dist").alias("length"))
        return pairs.join(d, (F.col("origin_id") == F.col("d_origin")) & (F.col("destination_id") == F.col("d_node")), "left").select("query_id", "length")
