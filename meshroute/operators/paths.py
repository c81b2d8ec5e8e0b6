"""Paths out of shortest-path trees, by pointer doubling, and the weights of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshroute.session import cut


def tall_paths(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, seq, node) from origin to destination for pairs (query_id, origin_id, destination_id).

    tree: (origin_id, node, dist, pred). Pairs out of reach have no rows. Ancestors at 1, 2, 4, ... steps are joined
    up until none is left, so that a path of n nodes takes about log2(n) joins.
    """
    jump = cut(tree.where("pred is not null").select(F.col("origin_id").alias("j_origin"), F.col("node").alias("j_node"), F.col("pred").alias("up")))
    jumps = []
    while jump.limit(1).count():
        jumps.append(jump)
        far = jump.select(F.col("j_origin").alias("k_origin"), F.col("j_node").alias("k_node"), F.col("up").alias("k_up"))
        jump = cut(jump.join(far, (F.col("j_origin") == F.col("k_origin")) & (F.col("up") == F.col("k_node"))).select("j_origin", "j_node", F.col("k_up").alias("up")))
    ends = tree.select(F.col("origin_id").alias("e_origin"), F.col("node").alias("e_node"))
    steps = pairs.join(ends, (F.col("origin_id") == F.col("e_origin")) & (F.col("destination_id") == F.col("e_node"))).select("query_id", "origin_id", F.col("destination_id").alias("node"), F.lit(0).alias("back"))
    for k in reversed(range(len(jumps))):
        more = steps.join(jumps[k], (F.col("origin_id") == F.col("j_origin")) & (F.col("node") == F.col("j_node"))).select("query_id", "origin_id", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        steps = cut(steps.unionByName(more))
    order = Window.partitionBy("query_id").orderBy(F.desc("back"))
    return steps.select("query_id", (F.row_number().over(order) - 1).alias("seq"), "node")


def gather(tall: DataFrame) -> DataFrame:
    """(query_id, path) with the nodes in order."""
    rows = tall.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node"))).alias("p"))
    return rows.select("query_id", F.transform("p", lambda x: x["node"]).alias("path"))


def tree_paths(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, length, path); length and path are null where the destination is out of reach."""
    d = tree.select(F.col("origin_id").alias("d_origin"), F.col("node").alias("d_node"), F.col("dist").alias("length"))
    p = gather(tall_paths(tree, pairs)).withColumnRenamed("query_id", "p_query")
    out = pairs.join(d, (F.col("origin_id") == F.col("d_origin")) & (F.col("destination_id") == F.col("d_node")), "left")
    return out.join(p, F.col("query_id") == F.col("p_query"), "left").select("query_id", "length", "path")


def path_weights(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, weight, missing) of paths (query_id, path): the sum over its edges, and how many of them don't exist.

    With an edge missing the weight is null.
    """
    hops = paths.select("query_id", F.posexplode("path").alias("seq", "node"))
    hops = hops.withColumn("to", F.lead("node").over(Window.partitionBy("query_id").orderBy("seq"))).where("to is not null")
    found = hops.join(edges.select("src", "dst", "weight"), (F.col("node") == F.col("src")) & (F.col("to") == F.col("dst")), "left")
    sums = found.groupBy(F.col("query_id").alias("s_query")).agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("weight").isNull(), 1).otherwise(0)).alias("missing"))
    out = paths.join(sums, F.col("query_id") == F.col("s_query"), "left")
    none = F.coalesce("missing", F.lit(0))
    return out.select("query_id", F.when(none == 0, F.coalesce("weight", F.lit(0.0))).alias("weight"), none.cast("long").alias("missing"))


def path_points(tall: DataFrame, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(query_id, points): the coordinates along tall paths, with the shapes of edges between them if edges are given."""
    at = tall.join(nodes.select("node_id", "lat", "lon"), F.col("node") == F.col("node_id"))
    at = at.select("query_id", "seq", "node", F.array(F.struct("lat", "lon")).alias("points"))
    if edges is not None and "shape" in edges.columns:
        at = at.withColumn("to", F.lead("node").over(Window.partitionBy("query_id").orderBy("seq")))
        shapes = edges.where("shape is not null").select("src", "dst", "shape")
        at = at.join(shapes, (F.col("node") == F.col("src")) & (F.col("to") == F.col("dst")), "left")
        at = at.withColumn("points", F.concat("points", F.coalesce("shape", F.array().cast(edges.schema["shape"].dataType))))
    rows = at.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("seq", "points"))).alias("p"))
    return rows.select("query_id", F.flatten(F.transform("p", lambda x: x["points"])).alias("points"))
