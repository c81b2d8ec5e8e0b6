"""Contraction hierarchies as tables: ranks, upward edges in both directions, and shortcuts with their middle node.

Nodes are contracted in rounds: of the nodes left, those whose priority is less than all their neighbours' (ties by a
hash) form an independent set and go together. The last few nodes, among which hardly two are not neighbours, stay as
a core whose edges count as upward in both directions. The order changes only the size of an index, never a distance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshroute.operators import relax
from meshroute.operators.model import Graph, check_ids, inverse
from meshroute.operators.relax import seeds_of
from meshroute.session import cut


@dataclass(frozen=True)
class Hierarchy:
    rank: DataFrame  # node_id, rank
    up: DataFrame  # src, dst, weight, via: edges to a higher rank
    down: DataFrame  # src, dst, weight, via: edges from a higher rank, turned round
    original: DataFrame | None = None  # src, dst, weight

    def save(self, path: str) -> None:
        for name in ("rank", "up", "down", "original"):
            if (df := getattr(self, name)) is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    def shortcuts(self) -> DataFrame:
        return self.up.where("via is not null").select("src", "dst", "via").unionByName(self.down.where("via is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "via")).distinct()


def load(spark: SparkSession, path: str, with_original: bool = True) -> Hierarchy:
    return Hierarchy(*[spark.read.parquet(f"{path}/{n}") for n in ("rank", "up", "down")], spark.read.parquet(f"{path}/original") if with_original else None)


def edge_difference() -> Column:
    """The usual priority: shortcuts a contraction may add, less the edges it takes, plus neighbours already gone."""
    return F.col("n_in") * F.col("n_out") - F.col("n_in") - F.col("n_out") + F.col("gone")


def build(graph: Graph, priority: Callable[[], Column] = edge_difference, witness_hops: int = 2, core: int = 8) -> Hierarchy:
    """The hierarchy of a graph with weights that are not negative.

    priority is an expression over n_in, n_out, gone and node_id. A shortcut is left out if a way of at most
    witness_hops (1 or 2) other edges is as short; a missed witness only costs a superfluous edge. core: how many
    nodes are left uncontracted at most.
    """
    loose = graph.edges.where("src <> dst")
    edges = cut(loose.groupBy("src", "dst").agg(F.min("weight").alias("weight")).withColumn("via", F.lit(None).cast("long")))
    left = cut(graph.nodes.select("node_id", F.lit(0).alias("gone")))
    ranks, kept, base = None, None, 0
    if not left.limit(1).count():
        raise ValueError("the graph has no node")
    while left.limit(core + 1).count() > core:
        n_out = edges.groupBy(F.col("src").alias("o_id")).agg(F.count("*").alias("n_out"))
        n_in = edges.groupBy(F.col("dst").alias("i_id")).agg(F.count("*").alias("n_in"))
        p = left.join(n_out, F.col("node_id") == F.col("o_id"), "left").join(n_in, F.col("node_id") == F.col("i_id"), "left").na.fill(0, ["n_in", "n_out"])
        p = cut(p.select("node_id", priority().cast("double").alias("p")))
        beside = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src")).distinct()
        key = lambda a, b: F.struct(F.col(a).alias("p"), F.xxhash64(b).alias("h"), F.col(b).alias("id"))
        lower = beside.join(p.toDF("y_id", "y_p"), F.col("y") == F.col("y_id")).groupBy("x").agg(F.min(key("y_p", "y_id")).alias("m"))
        go = p.join(lower, F.col("node_id") == F.col("x"), "left").where(F.col("m").isNull() | (key("p", "node_id") < F.col("m"))).select("node_id")
        go = cut(go)
        ids = go.select(F.col("node_id").alias("go_id"))
        part = go.select("node_id", F.lit(base).alias("round"))
        ranks = part if ranks is None else ranks.unionByName(part)
        base += 1
        ins = edges.join(ids, F.col("dst") == F.col("go_id"))
        outs = edges.join(ids, F.col("src") == F.col("go_id"))
        own = cut(ins.select("src", "dst", "weight", "via").unionByName(outs.select("src", "dst", "weight", "via")))
        kept = own if kept is None else kept.unionByName(own)
        rest = edges.join(ids, F.col("src") == F.col("go_id"), "left_anti").join(ids, F.col("dst") == F.col("go_id"), "left_anti")
        a = ins.select(F.col("src").alias("a"), F.col("go_id").alias("v"), F.col("weight").alias("aw"))
        b = outs.select(F.col("dst").alias("b"), F.col("go_id").alias("bv"), F.col("weight").alias("bw"))
        new = a.join(b, (F.col("v") == F.col("bv")) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.min(F.struct((F.col("aw") + F.col("bw")).alias("weight"), F.col("v"))).alias("s")).select("a", "b", F.col("s.weight").alias("weight"), F.col("s.v").alias("via"))
        new = cut(new)
        if witness_hops > 1:
            r1 = rest.select(F.col("src").alias("r_a"), F.col("dst").alias("r_m"), F.col("weight").alias("r_w"))
            r2 = rest.select(F.col("src").alias("q_m"), F.col("dst").alias("q_b"), F.col("weight").alias("q_w"))
            seen = new.join(r1, F.col("a") == F.col("r_a")).join(r2, (F.col("r_m") == F.col("q_m")) & (F.col("b") == F.col("q_b"))).where(F.col("r_w") + F.col("q_w") <= F.col("weight")).select(F.col("a").alias("w_a"), F.col("b").alias("w_b")).distinct()
            new = new.join(seen, (F.col("a") == F.col("w_a")) & (F.col("b") == F.col("w_b")), "left_anti")
        merged = rest.select("src", "dst", "weight", "via").unionByName(new.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "via"))
        # Of equally short edges the original one stays.
        first = F.min(F.struct("weight", F.col("via").isNotNull().alias("made"), "via"))
        edges = cut(merged.groupBy("src", "dst").agg(first.alias("e")).select("src", "dst", F.col("e.weight").alias("weight"), F.col("e.via").alias("via")))
        gone = beside.join(ids, F.col("x") == F.col("go_id")).groupBy(F.col("y").alias("g_id")).agg(F.count("*").alias("more"))
        left = cut(left.join(ids, F.col("node_id") == F.col("go_id"), "left_anti").join(gone, F.col("node_id") == F.col("g_id"), "left").select("node_id", (F.col("gone") + F.coalesce("more", F.lit(0))).cast("int").alias("gone")))
    part = left.select("node_id", F.lit(base).alias("round"))
    ranks = cut(part if ranks is None else ranks.unionByName(part))
    # Ranks count up through the rounds; within a round by id, from counts of the rounds before.
    before = Window.partitionBy("k").orderBy("round")
    sizes = ranks.groupBy("round").count().withColumn("k", F.lit(0)).withColumn("before", F.sum("count").over(before) - F.col("count")).select(F.col("round").alias("b_round"), "before")
    ranks = cut(ranks.withColumn("at", F.row_number().over(Window.partitionBy("round").orderBy("node_id"))).join(sizes, F.col("round") == F.col("b_round")).select("node_id", (F.col("before") + F.col("at") - 1).cast("long").alias("rank")))
    r = lambda a, b: ranks.toDF(a, b)
    kept = kept if kept is not None else edges.limit(0)
    placed = kept.join(r("s_id", "s_rank"), F.col("src") == F.col("s_id")).join(r("d_id", "d_rank"), F.col("dst") == F.col("d_id"))
    turned = [F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "via"]
    up = cut(placed.where("s_rank < d_rank").select("src", "dst", "weight", "via").unionByName(edges))
    down = cut(placed.where("s_rank > d_rank").select(*turned).unionByName(edges.select(*turned)))
    return Hierarchy(ranks, up, down, cut(graph.edges.select("src", "dst", "weight")))


def distances(index: Hierarchy, pairs: DataFrame) -> DataFrame:
    """(query_id, length, meet) of pairs (query_id, origin_id, destination_id), without those out of reach. Ids that the
    index lacks raise ValueError."""
    check_ids(index.rank, pairs)
    f = cut(relax.trees(index.up, seeds_of(pairs.select("origin_id").distinct())))
    b = cut(relax.trees(index.down, seeds_of(pairs.select("destination_id").distinct(), "destination_id")))
    fwd = pairs.join(f.toDF("f_origin", "f_node", "f_dist"), F.col("origin_id") == F.col("f_origin"))
    met = fwd.join(b.toDF("b_origin", "b_node", "b_dist"), (F.col("destination_id") == F.col("b_origin")) & (F.col("f_node") == F.col("b_node")))
    best = met.groupBy("query_id").agg(F.min(F.struct((F.col("f_dist") + F.col("b_dist")).alias("length"), F.col("f_node").alias("meet"))).alias("m"))
    return best.select("query_id", "m.length", "m.meet")


def search(index: Hierarchy, pairs: DataFrame) -> DataFrame:
    """(query_id, length, path) of pairs; null where no way leads. Ids that the index lacks raise ValueError."""
    from meshroute.operators import paths

    best = cut(distances(index, pairs))
    ends = cut(pairs.join(best.withColumnRenamed("query_id", "m_query"), F.col("query_id") == F.col("m_query")).select("query_id", "origin_id", "destination_id", "length", "meet"))

    def half(edges: DataFrame, end: str) -> DataFrame:
        origins = ends.select(F.col(end).alias("origin_id")).distinct()
        dist = cut(relax.trees(edges, seeds_of(origins)))
        tree = cut(relax.predecessors(edges, dist, origins.select("origin_id", F.col("origin_id").alias("node"))))
        return cut(paths.tall_paths(tree, ends.select("query_id", F.col(end).alias("origin_id"), F.col("meet").alias("destination_id"))))

    there, back = half(index.up, "origin_id"), half(index.down, "destination_id")
    n = there.groupBy(F.col("query_id").alias("n_query")).agg(F.max("seq").alias("n"))
    last = back.groupBy(F.col("query_id").alias("l_query")).agg(F.max("seq").alias("last"))
    rest = back.join(last, F.col("query_id") == F.col("l_query")).where("seq < last").join(n, F.col("query_id") == F.col("n_query")).select("query_id", (F.col("n") + F.col("last") - F.col("seq")).alias("seq"), "node")
    chain = there.unionByName(rest)
    hop = chain.withColumn("to", F.lead("node").over(Window.partitionBy("query_id").orderBy("seq")))
    full = unpack(index, hop.where("to is not null").select("query_id", "seq", F.col("node").alias("src"), F.col("to").alias("dst")))
    firsts = chain.where("seq = 0").select("query_id", F.array(F.struct(F.array(F.lit(-1.0)).alias("at"), F.col("node"))).alias("first"))
    rows = full.groupBy(F.col("query_id").alias("u_query")).agg(F.sort_array(F.collect_list(F.struct("at", F.col("dst").alias("node")))).alias("rest"))
    path = firsts.join(rows, F.col("query_id") == F.col("u_query"), "left").select(F.col("query_id").alias("p_query"), F.transform(F.concat("first", F.coalesce("rest", F.array().cast("array<struct<at:array<double>,node:bigint>>"))), lambda x: x["node"]).alias("path"))
    out = pairs.select("query_id").join(best.select(F.col("query_id").alias("m_query"), "length"), F.col("query_id") == F.col("m_query"), "left")
    return out.join(path, F.col("query_id") == F.col("p_query"), "left").select("query_id", "length", "path")


def unpack(index: Hierarchy, hops: DataFrame) -> DataFrame:
    """(query_id, at, src, dst): the original edges of hops (query_id, seq, src, dst), `at` puts them in order."""
    cuts = cut(index.shortcuts())
    rows = cut(hops.select("query_id", F.array(F.col("seq").cast("double")).alias("at"), "src", "dst"))
    s = cuts.toDF("s_src", "s_dst", "via")
    while True:
        wide = rows.join(s, (F.col("src") == F.col("s_src")) & (F.col("dst") == F.col("s_dst")), "left")
        if not wide.where("via is not null").limit(1).count():
            return rows
        halves = F.when(F.col("via").isNull(), F.array(F.struct("at", "src", "dst"))).otherwise(
            F.array(F.struct(F.concat("at", F.array(F.lit(0.0))).alias("at"), F.col("src"), F.col("via").alias("dst")), F.struct(F.concat("at", F.array(F.lit(1.0))).alias("at"), F.col("via").alias("src"), F.col("dst")))
        )
        rows = cut(wide.select("query_id", F.explode(halves).alias("h")).select("query_id", "h.*"))


def add_node(index: Hierarchy, node_id: int, out: DataFrame, symmetric: bool = True) -> Hierarchy:
    """The index with one more node above all others, with edges out(dst, weight), also back if symmetric."""
    top = index.rank.agg(F.max("rank")).first()[0] + 1
    spark = index.rank.sparkSession
    rank = index.rank.unionByName(spark.createDataFrame([(node_id, top)], "node_id long, rank long"))
    new = out.select(F.lit(node_id).cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    none = F.lit(None).cast("long").alias("via")
    # From the new node all edges lead down; the ways back lead up.
    down = index.down.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", none))
    up = index.up.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", none)) if symmetric else index.up
    original = index.original and index.original.unionByName(new.unionByName(inverse(new)) if symmetric else new)
    return Hierarchy(rank, up, down, original)
