"""Graphs as DataFrames: edges(src, dst, weight), unique by (src, dst), and nodes(node_id[, lat, lon]).

Values are immutable; every change gives a new graph. Isolated nodes live only in the node table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    nodes: DataFrame
    version: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def with_(self, **changes) -> Graph:
        """A changed copy, of the next version."""
        return replace(self, version=self.version + 1, **changes)

    def size(self) -> int:
        return self.nodes.count()

    def neighbours(self, node_id: int) -> DataFrame:
        return self.edges.where(F.col("src") == node_id).select("dst", "weight")

    def packed(self) -> DataFrame:
        """adjacency(src, out): the out-edges of each node as an array of (dst, weight)."""
        out = self.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("out"))
        return self.nodes.select("node_id").join(out, F.col("node_id") == F.col("src"), "left").select(F.col("node_id").alias("src"), F.coalesce("out", F.array().cast("array<struct<dst:bigint,weight:double>>")).alias("out"))

    def inverse(self) -> Graph:
        return self.with_(edges=inverse(self.edges))


@dataclass(frozen=True)
class GeoGraph(Graph):
    """nodes have lat and lon; edges may have a shape, an array of (lat, lon) between the ends."""

    units: str = "km"
    off_graph_circuity: float = 1.0
    node_addition_circuity: float = 4.0


def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """A graph of rows (src, dst, weight); of parallel edges the lightest stays."""
    edges = lightest(edges)
    if nodes is None:
        nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return Graph(edges, nodes)


def from_adjacency(spark: SparkSession, adjacency: list[dict[int, float]]) -> Graph:
    """A graph of a list of maps: place = source, key = destination."""
    rows = spark.createDataFrame([(i, {int(k): float(v) for k, v in m.items()}) for i, m in enumerate(adjacency)], "src long, out map<long,double>")
    edges = rows.select("src", F.explode("out").alias("dst", "weight"))
    return Graph(edges, rows.select(F.col("src").alias("node_id")))


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Rows (src, out map) as edges; back by to_pairs()."""
    return pairs.select("src", F.explode("out").alias("dst", "weight"))


def to_pairs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("out"))


def lightest(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the lightest of parallel ones; combined before the shuffle."""
    return edges.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.min(F.col("weight").cast("double")).alias("weight"))


def lightest_rows(edges: DataFrame) -> DataFrame:
    """As lightest(), with the other columns of the lightest edge; of equally light ones the least by these."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "weight")]
    if not rest:
        return lightest(edges)
    row = F.min(F.struct(F.col("weight").cast("double").alias("weight"), *rest)).alias("e")
    best = edges.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(row)
    return best.select("src", "dst", "e.weight", *[F.col(f"e.{c}").alias(c) for c in rest])


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return lightest(edges.select("src", "dst", "weight").unionByName(inverse(edges)))


# ---- Changes


def add_node(graph: Graph, out: DataFrame | None = None, symmetric: bool = False, **columns) -> tuple[Graph, int]:
    """A new last node with edges out(dst, weight), also back if symmetric; and its id."""
    spark = graph.spark
    new = (graph.nodes.agg(F.max("node_id")).first()[0] or 0) + 1 if graph.nodes.limit(1).count() else 0
    row = spark.range(1).select(F.lit(new).cast("long").alias("node_id"), *[F.lit(columns.get(c)).cast(graph.nodes.schema[c].dataType).alias(c) for c in graph.nodes.columns if c != "node_id"])
    grown = graph.with_(nodes=graph.nodes.unionByName(row))
    if out is not None:
        edges = out.select(F.lit(new).cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
        grown = add_edges(grown, edges.unionByName(inverse(edges)) if symmetric else edges)
    return grown, new


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """Puts rows (src, dst, weight) in, replacing edges of the same ends."""
    keys = new.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"))
    kept = graph.edges.join(keys, (F.col("src") == F.col("n_src")) & (F.col("dst") == F.col("n_dst")), "left_anti")
    return graph.with_(edges=kept.unionByName(new, allowMissingColumns=True))


def add_edge(graph: Graph, src: int, dst: int, weight: float, symmetric: bool = False) -> Graph:
    rows = [(src, dst, float(weight)), *([(dst, src, float(weight))] if symmetric and src != dst else [])]
    return add_edges(graph, graph.spark.createDataFrame(rows, "src long, dst long, weight double"))


def remove_edge(graph: Graph, src: int, dst: int, symmetric: bool = False) -> tuple[Graph, float | None]:
    """The graph without the edge, and the edge's weight (None: there was none)."""
    at = (F.col("src") == src) & (F.col("dst") == dst)
    row = graph.edges.where(at).select("weight").first()
    if symmetric:
        at |= (F.col("src") == dst) & (F.col("dst") == src)
    return graph.with_(edges=graph.edges.where(~at)), row and row[0]


def remove_last_node(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph without its last node and all edges that touch it, and the node's out-edges."""
    last = graph.nodes.agg(F.max("node_id")).first()[0]
    if last is None:
        raise ValueError("the graph has no node")
    out = graph.edges.where(F.col("src") == last).select("dst", "weight")
    return graph.with_(edges=graph.edges.where((F.col("src") != last) & (F.col("dst") != last)), nodes=graph.nodes.where(F.col("node_id") != last)), out


# ---- Checks


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges without an equal edge back."""
    back = edges.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), F.col("weight").alias("b_weight"))
    return edges.join(back.hint("merge"), (F.col("src") == F.col("b_dst")) & (F.col("dst") == F.col("b_src")) & (F.col("weight") == F.col("b_weight")), "left_anti")


def check_ids(nodes: DataFrame, pairs: DataFrame) -> None:
    """Raises ValueError if an origin_id or destination_id of pairs isn't a node_id."""
    ids = pairs.select(F.col("origin_id").alias("id")).union(pairs.select("destination_id")).distinct()
    bad = [r.id for r in ids.join(nodes.select("node_id"), F.col("id") == F.col("node_id"), "left_anti").limit(5).collect()]
    if bad:
        raise ValueError(f"not nodes of the graph: {bad}")


def dangling_edges(graph: Graph) -> DataFrame:
    """Edges one of whose ends is no node."""
    ids = graph.nodes.select("node_id").hint("merge")  # else they pass through the driver, as long as they are just small enough
    return graph.edges.join(ids, F.col("src") == F.col("node_id"), "left_anti").unionByName(graph.edges.join(ids, F.col("dst") == F.col("node_id"), "left_anti"))


def validate(graph: Graph, check_symmetry: bool = True, check_connected: bool = True) -> DataFrame:
    """rule, violations: one row for each rule; a valid graph has 0 in each."""
    from meshroute.operators.relax import unreached

    counts = [
        ("no_nodes", graph.nodes.limit(1).agg((1 - F.count("*")).alias("violations"))),
        ("dangling_edges", dangling_edges(graph).agg(F.count("*").alias("violations"))),
        ("negative_or_missing_weights", graph.edges.agg(F.coalesce(F.sum(F.when(F.coalesce(F.col("weight") < 0, F.lit(True)), 1).otherwise(0)), F.lit(0)).alias("violations"))),
    ]
    if check_symmetry:
        counts.append(("asymmetric_edges", asymmetric_edges(graph.edges).agg(F.count("*").alias("violations"))))
    if check_connected:
        counts.append(("unreached_nodes", unreached(graph).agg(F.count("*").alias("violations"))))
    out = None
    for rule, df in counts:
        row = df.select(F.lit(rule).alias("rule"), F.col("violations").cast("long").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def assert_valid(graph: Graph, **checks) -> None:
    bad = validate(graph, **checks).where("violations > 0").collect()  # one row for each rule
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in bad))


def invalid_points(nodes: DataFrame) -> DataFrame:
    from meshroute.functions.geodesy import valid_point

    return nodes.where(~valid_point("lat", "lon"))
