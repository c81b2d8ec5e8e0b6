"""Shortest paths as set-based relaxation.

All origins share the rounds. The state is one row for each (origin, node) reached: its distance, the node before it, and
whether it is still to be spread. A round joins the rows to spread with the edges, keeps the least distance for each node
(combined before the shuffle), and merges. The state is written to the shared folder after every round, which cuts lineage;
no row ever reaches the driver: joins of a round are by sorting, since each table that was broadcast instead, as Spark would do
with those that happen to be small, would pass through it. With weights that are not negative the fixpoint is Dijkstra's result bit for bit, as
addition is monotone and both add from the origin on.

Graphs of at most KERNEL_EDGES edges (counted first) are sent to the executors instead; see kernel.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshroute.operators import kernel
from meshroute.operators.kernel import KERNEL_EDGES, Adjacency, NegativeCycle, kernel_trees
from meshroute.operators.model import Graph, inverse
from meshroute.session import cut

__all__ = ["KERNEL_EDGES", "STRATEGIES", "Adjacency", "NegativeCycle", "kernel_trees", "predecessors", "relax", "seeds_of", "strategy_named", "trees"]


def seeds_of(origins: DataFrame, column: str = "origin_id") -> DataFrame:
    """Each origin at distance 0 from itself."""
    o = F.col(column).cast("long")
    return origins.select(o.alias("origin_id"), o.alias("node"), F.lit(0.0).alias("dist"))


def relax(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    delta: float | None = None,
    targets: DataFrame | None = None,
    remaining: Column | None = None,
    places: DataFrame | None = None,
    everything: bool = False,
    most_rounds: int | None = None,
    signed: bool = False,
    stop: DataFrame | None = None,
) -> DataFrame:
    """(origin_id, node, dist) for all nodes that the seeds (origin_id, node, dist) reach.

    delta: spread only the rows in the lowest bucket of this width in each round.
    targets: (origin_id, target[, ...]) with one target each; rows that can't improve on it aren't spread, and only
        distances at and before targets are final. remaining, an expression over node, the columns of targets and
        those of places (place, ...), a row for each node, bounds the way still to go from below.
    everything: spread all rows in every round.
    most_rounds: raise NegativeCycle if distances still fall after so many.
    signed: weights may be negative. After 1, 2, 4, ... rounds the links to the nodes before are followed by doubling:
        NegativeCycle if they run in a circle, which they do once distances have gone round a negative cycle.
    stop: (stop_node); distances to these are found, but not spread from.
    """
    e = edges.select("src", "dst", "weight")
    state = cut(seeds.groupBy("origin_id", "node").agg(F.min("dist").alias("dist")).withColumn("before", F.lit(None).cast("long")).withColumn("todo", F.lit(True)))
    rounds, check = 0, 1
    while True:
        low = state.where("todo").agg(F.min("dist")).first()[0]
        if low is None:
            return state.select("origin_id", "node", "dist")
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise NegativeCycle(f"distances still fall after {most_rounds} rounds")
        if signed and rounds > check:
            check *= 2
            if _circles(state):
                raise NegativeCycle("a cycle that is reached has a negative sum")
        chosen = F.lit(True) if everything else F.col("todo")
        if delta:
            chosen &= F.col("dist") < (np.floor(low / delta) + 1) * delta
        front = state.where(chosen)
        if stop is not None:
            front = front.join(stop, F.col("node") == F.col("stop_node"), "left_anti")
        if targets is not None:
            t = targets.withColumnRenamed("origin_id", "t_origin")
            best = state.join(t, (F.col("origin_id") == F.col("t_origin")) & (F.col("node") == F.col("target"))).select(F.col("origin_id").alias("b_origin"), F.col("dist").alias("best"))
            front = front.join(t, F.col("origin_id") == F.col("t_origin")).join(best, F.col("origin_id") == F.col("b_origin"), "left")
            if places is not None:
                front = front.join(places, F.col("node") == F.col("place"))
            ahead = remaining if remaining is not None else F.lit(0.0)
            # A hair of slack, as the bound is rounded otherwise than the sum of weights.
            front = front.where(F.col("best").isNull() | (F.col("dist") + ahead <= F.col("best") * (1 + 1e-12)))
        step = front.select("origin_id", "node", "dist").hint("merge").join(e, F.col("node") == F.col("src"))
        step = step.groupBy(F.col("origin_id").alias("c_origin"), F.col("dst").alias("c_node")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("d"), F.col("src").alias("s"))).alias("c"))
        step = step.select("c_origin", "c_node", F.col("c.d").alias("c_dist"), F.col("c.s").alias("c_before"))
        both = state.join(step, (F.col("origin_id") == F.col("c_origin")) & (F.col("node") == F.col("c_node")), "full_outer")
        better = F.col("c_dist").isNotNull() & (F.col("dist").isNull() | (F.col("c_dist") < F.col("dist")))
        state = cut(
            both.select(
                F.coalesce("origin_id", "c_origin").alias("origin_id"),
                F.coalesce("node", "c_node").alias("node"),
                F.when(better, F.col("c_dist")).otherwise(F.col("dist")).alias("dist"),
                F.when(better, F.col("c_before")).otherwise(F.col("before")).alias("before"),
                (better | F.coalesce(F.col("todo") & ~chosen, F.lit(False))).alias("todo"),
            )
        )


def _circles(state: DataFrame) -> bool:
    """Whether the links of (origin_id, node, before) run in a circle: then there are ancestors however far one goes."""
    links = cut(state.where("before is not null").select("origin_id", "node", F.col("before").alias("up")))
    n, far = links.groupBy("origin_id").count().agg(F.max("count")).first()[0] or 0, 1
    while far <= n:
        again = links.select(F.col("origin_id").alias("k_origin"), F.col("node").alias("k_node"), F.col("up").alias("k_up"))
        links = cut(links.join(again, (F.col("origin_id") == F.col("k_origin")) & (F.col("up") == F.col("k_node"))).select("origin_id", "node", F.col("k_up").alias("up")))
        far *= 2
        if not links.limit(1).count():
            return False
    return links.limit(1).count() > 0


def trees(edges: DataFrame, seeds: DataFrame, strategy: str = "auto", **options) -> DataFrame:
    """Distances by the strategy: ``loop``, ``kernel``, or ``auto`` by the number of edges and their signs."""
    if strategy == "auto":
        strategy = "loop"
        if not options:
            n, least = kernel.edge_count(edges)
            strategy = "kernel" if n <= KERNEL_EDGES and (least is None or least >= 0) else "loop"
    return kernel_trees(edges, seeds) if strategy == "kernel" else relax(edges, seeds, **options)


def tree_sums(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin_id, reached, total, furthest): the number, the sum and the longest of the distances of trees()."""
    n, least = kernel.edge_count(edges)
    if n <= KERNEL_EDGES and (least is None or least >= 0):
        return kernel.kernel_sums(edges, seeds)
    return relax(edges, seeds).groupBy("origin_id").agg(F.count("*").alias("reached"), F.sum("dist").alias("total"), F.max("dist").alias("furthest"))


def predecessors(edges: DataFrame, dist: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin_id, node, dist, pred); pred is null at origins.

    Of the neighbours over which a node's distance comes about exactly, the nearest to the origin, then the least id:
    the order in which a heap of (distance, id) would settle them. Weights must be positive.
    """
    d = dist.select("origin_id", "node", "dist")
    start = origins.select(F.col("origin_id").alias("s_origin"), F.col("node").alias("s_node"))
    tight = d.join(edges.select("src", "dst", "weight"), F.col("node") == F.col("src")).select(F.col("origin_id").alias("u_origin"), F.col("node").alias("u"), F.col("dist").alias("u_dist"), "dst", (F.col("dist") + F.col("weight")).alias("over"))
    tight = tight.join(d, (F.col("u_origin") == F.col("origin_id")) & (F.col("dst") == F.col("node")) & (F.col("over") == F.col("dist")))
    tight = tight.groupBy(F.col("origin_id").alias("p_origin"), F.col("node").alias("p_node")).agg(F.min(F.struct("u_dist", "u"))["u"].alias("pred"))
    out = d.join(tight, (F.col("origin_id") == F.col("p_origin")) & (F.col("node") == F.col("p_node")), "left")
    out = out.join(start, (F.col("origin_id") == F.col("s_origin")) & (F.col("node") == F.col("s_node")), "left")
    return out.select("origin_id", "node", "dist", F.when(F.col("s_node").isNull(), F.col("pred")).alias("pred"))


def predecessors_any_sign(edges: DataFrame, dist: DataFrame, origins: DataFrame) -> DataFrame:
    """As predecessors(), for weights of any sign and no cycle of weight nought or less: hops break what ties leave."""
    d = dist.select("origin_id", "node", "dist")
    tight = d.join(edges.select("src", "dst", "weight"), F.col("node") == F.col("src")).select(F.col("origin_id").alias("u_origin"), F.col("node").alias("u"), "dst", (F.col("dist") + F.col("weight")).alias("over"))
    tight = tight.join(d, (F.col("u_origin") == F.col("origin_id")) & (F.col("dst") == F.col("node")) & (F.col("over") == F.col("dist"))).select(F.col("u").alias("src"), F.col("dst"), F.lit(1.0).alias("weight"), "origin_id")
    tight = cut(tight)
    start = origins.select(F.col("origin_id").alias("s_origin"), F.col("node").alias("s_node"))
    hops = cut(start.select(F.col("s_origin").alias("origin_id"), F.col("s_node").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("pred")))
    front = hops
    while front.limit(1).count():
        f = front.select(F.col("origin_id").alias("f_origin"), F.col("node").alias("f_node"), "hops")
        step = f.join(tight, (F.col("f_origin") == F.col("origin_id")) & (F.col("f_node") == F.col("src"))).groupBy("origin_id", F.col("dst").alias("node")).agg((F.min("hops") + 1).alias("hops"), F.min("src").alias("pred"))
        seen = hops.select(F.col("origin_id").alias("h_origin"), F.col("node").alias("h_node"))
        front = cut(step.join(seen, (F.col("origin_id") == F.col("h_origin")) & (F.col("node") == F.col("h_node")), "left_anti"))
        hops = cut(hops.unionByName(front))
    h = hops.select(F.col("origin_id").alias("h_origin"), F.col("node").alias("h_node"), "pred")
    return d.join(h, (F.col("origin_id") == F.col("h_origin")) & (F.col("node") == F.col("h_node"))).select("origin_id", "node", "dist", "pred")


# ---- Strategies by name. Each takes (edges, seeds, targets or None) and gives distances. targets: (origin_id, target).


def dijkstra(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    return trees(edges, seeds) if targets is None else relax(edges, seeds, targets=targets)


def dijkstra_buckets(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, max_edge_weight: float | None = None) -> DataFrame:
    """Buckets as wide as the largest weight, so that a bucket is done after few rounds."""
    wide = max_edge_weight if max_edge_weight is not None else edges.agg(F.max("weight")).first()[0]
    return relax(edges, seeds, targets=targets, delta=wide or 1.0)


def _signed(edges: DataFrame, seeds: DataFrame, strategy: str, **options) -> DataFrame:
    if strategy == "kernel" or strategy == "auto" and kernel.fits(edges):
        out = cut(kernel.kernel_signed(edges, seeds))
        if out.where("wrong").limit(1).count():
            raise NegativeCycle("a cycle that is reached has a negative sum")
        return out.drop("wrong")
    return relax(edges, seeds, signed=True, **options)


def dijkstra_negative(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """Weights of any sign; NegativeCycle if a reachable cycle has a negative sum. strategy: as in trees()."""
    return _signed(edges, seeds, strategy)


def bellman_ford(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """As dijkstra_negative(); the loop spreads every row in every round."""
    return _signed(edges, seeds, strategy, everything=True)


def bmssp(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None, width: int = 4) -> DataFrame:
    """Bounded multi-source rounds, as buckets: all below a bound is settled before the bound moves on by `width` largest
    weights. The recursion over pivots by which the sequential algorithm avoids sorting has no use here, as nothing is sorted
    and a round relaxes all rows below the bound at once."""
    wide = edges.agg(F.max("weight")).first()[0]
    return relax(edges, seeds, targets=targets, delta=(wide or 1.0) * width)


def a_star(edges: DataFrame, seeds: DataFrame, targets: DataFrame, heuristic: Column | None = None, places: DataFrame | None = None) -> DataFrame:
    """heuristic: an expression over node and the columns of targets and places that never exceeds the way still to go."""
    return relax(edges, seeds, targets=targets, remaining=heuristic, places=places)


STRATEGIES = {f.__name__: f for f in (dijkstra, dijkstra_buckets, dijkstra_negative, bellman_ford, bmssp, a_star)}


def strategy_named(name):
    """A strategy by its name, or a callable as it is."""
    if callable(name):
        return name
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


# ---- Reachability


def reached(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin_id, node) for everything the origins reach, themselves included; by breadth, in rounds."""
    links = cut(edges.select("src", "dst").distinct())
    seen = cut(origins.select(F.col("origin_id").cast("long").alias("origin_id"), F.col("origin_id").cast("long").alias("node")).distinct())
    front = seen
    while True:
        step = front.hint("merge").join(links, F.col("node") == F.col("src")).select("origin_id", F.col("dst").alias("node")).distinct()
        old = seen.select(F.col("origin_id").alias("o_origin"), F.col("node").alias("o_node"))
        front = cut(step.join(old.hint("merge"), (F.col("origin_id") == F.col("o_origin")) & (F.col("node") == F.col("o_node")), "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def unreached(graph: Graph, origin_id: int | None = None) -> DataFrame:
    """Nodes that the origin (the least node by default) doesn't reach, or that don't reach it."""
    first = graph.nodes.agg(F.min("node_id").alias("origin_id")) if origin_id is None else graph.spark.range(1).select(F.lit(origin_id).cast("long").alias("origin_id"))
    first = first.where("origin_id is not null")
    there = reached(graph.edges, first).select(F.col("node").alias("t"))
    back = reached(inverse(graph.edges), first).select(F.col("node").alias("b"))
    ids = graph.nodes.select("node_id")
    gone = ids.join(there.hint("merge"), F.col("node_id") == F.col("t"), "left_anti").union(ids.join(back.hint("merge"), F.col("node_id") == F.col("b"), "left_anti"))
    return gone.distinct()
