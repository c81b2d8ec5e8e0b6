"""Transit-node routing over a hierarchy: the highest nodes, a table of all distances between them, and for every node
the transit nodes first met on the way up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshroute.operators import hierarchy, relax
from meshroute.operators.hierarchy import Hierarchy
from meshroute.operators.model import check_ids
from meshroute.session import cut


@dataclass(frozen=True)
class Transit:
    index: Hierarchy
    nodes: DataFrame  # t
    table: DataFrame  # t1, t2, d
    access: DataFrame  # node, t, d, forward

    def save(self, path: str) -> None:
        self.index.save(f"{path}/index")
        for name in ("nodes", "table", "access"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Transit:
    return Transit(hierarchy.load(spark, f"{path}/index"), *[spark.read.parquet(f"{path}/{n}") for n in ("nodes", "table", "access")])


def build(index: Hierarchy, transit_nodes: int = 100) -> Transit:
    """The `transit_nodes` highest nodes; their table is at most the square of that number."""
    t = cut(index.rank.orderBy(F.desc("rank")).limit(transit_nodes).select(F.col("node_id").alias("t")))
    dist = relax.trees(index.original, relax.seeds_of(t, "t"))
    table = cut(dist.join(t, F.col("node") == F.col("t"), "left_semi").select(F.col("origin_id").alias("t1"), F.col("node").alias("t2"), F.col("dist").alias("d")))
    everyone = index.rank.select(F.col("node_id").alias("origin_id"))
    stop = t.select(F.col("t").alias("stop_node"))

    def up(edges: DataFrame, forward: bool) -> DataFrame:
        way = relax.relax(edges, relax.seeds_of(everyone), stop=stop)
        return way.join(t, F.col("node") == F.col("t")).select(F.col("origin_id").alias("node"), "t", F.col("dist").alias("d"), F.lit(forward).alias("forward"))

    access = cut(up(index.up, True).unionByName(up(index.down, False)))
    return Transit(index, t, table, access)


def distances(index: Transit, pairs: DataFrame) -> DataFrame:
    """(query_id, length) of pairs (query_id, origin_id, destination_id): the better of the way over the table and the
    local way below the transit nodes; null where neither leads. Ids that the index lacks raise ValueError."""
    check_ids(index.index.rank, pairs)
    a = index.access.where("forward").select(F.col("node").alias("a_node"), F.col("t").alias("a_t"), F.col("d").alias("a_d"))
    b = index.access.where("not forward").select(F.col("node").alias("b_node"), F.col("t").alias("b_t"), F.col("d").alias("b_d"))
    far = pairs.join(a, F.col("origin_id") == F.col("a_node")).join(index.table, F.col("a_t") == F.col("t1")).join(b, (F.col("destination_id") == F.col("b_node")) & (F.col("t2") == F.col("b_t")))
    over = far.groupBy(F.col("query_id").alias("o_query")).agg(F.min(F.col("a_d") + F.col("d") + F.col("b_d")).alias("over"))
    stop = index.nodes.select(F.col("t").alias("stop_node"))
    f = relax.relax(index.index.up, relax.seeds_of(pairs.select("origin_id").distinct()), stop=stop)
    g = relax.relax(index.index.down, relax.seeds_of(pairs.select("destination_id").distinct(), "destination_id"), stop=stop)
    near = pairs.join(f.toDF("f_origin", "f_node", "f_dist"), F.col("origin_id") == F.col("f_origin")).join(g.toDF("g_origin", "g_node", "g_dist"), (F.col("destination_id") == F.col("g_origin")) & (F.col("f_node") == F.col("g_node")))
    local = near.groupBy(F.col("query_id").alias("l_query")).agg(F.min(F.col("f_dist") + F.col("g_dist")).alias("local"))
    out = pairs.select("query_id").join(over, F.col("query_id") == F.col("o_query"), "left").join(local, F.col("query_id") == F.col("l_query"), "left")
    return out.select("query_id", F.least("over", "local").alias("length"))


def search(index: Transit, pairs: DataFrame) -> DataFrame:
    """(query_id, length, path). The table has lengths only, as distances() uses it; a path comes from the hierarchy below,
    which has the nodes between."""
    return hierarchy.search(index.index, pairs)
