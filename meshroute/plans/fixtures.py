"""Graphs derived from the driver tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshroute.operators.model import GeoGraph, Graph, lightest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of low diameter over the parts: p to 2p, 2p + 1 and p + 1, modulo their number."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    n = p.agg(F.count("*").alias("n"))
    n = n.first()[0]
    steps = F.explode(F.array(*[F.struct(((2 * F.col("p") + b) % n).alias("dst"), (1 + (7 * F.col("p") + 13 * b) % 10).alias("weight")) for b in (0, 1)], F.struct(((F.col("p") + 1) % n).alias("dst"), (1 + (7 * F.col("p") + 26) % 10).alias("weight"))))
    return lightest(p.select(F.col("p").alias("src"), steps.alias("s")).select("src", "s.dst", "s.weight"))


PART_SQL = """n AS (SELECT count(*)::BIGINT AS n FROM part),
e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, min(w)::BIGINT AS w FROM (
  SELECT p_partkey AS src, (2 * p_partkey + b) % n AS dst, 1 + (7 * p_partkey + 13 * b) % 10 AS w FROM part, n, (VALUES (0), (1)) AS t(b)
  UNION ALL SELECT p_partkey, (p_partkey + 1) % n, 1 + (7 * p_partkey + 26) % 10 FROM part, n) GROUP BY 1, 2)"""


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symmetric graph of the 25 nations: n with n + 1 and n + 7."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), F.explode(F.array(F.lit(1), F.lit(7))).alias("s")).select("a", ((F.col("a") + F.col("s")) % 25).alias("b"))
    w = 1 + (7 * F.least("a", "b") + 13 * F.greatest("a", "b")) % 10
    return lightest(n.select(F.col("a").alias("src"), F.col("b").alias("dst"), w.alias("weight")).union(n.select("b", "a", w)))


RING_SQL = """r0 AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey + s) % 25 AS b FROM nation, (VALUES (1), (7)) AS t(s)),
e AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, min(w)::BIGINT AS w FROM (
  SELECT a AS src, b AS dst, 1 + (7 * least(a, b) + 13 * greatest(a, b)) % 10 AS w FROM r0
  UNION ALL SELECT b, a, 1 + (7 * least(a, b) + 13 * greatest(a, b)) % 10 FROM r0) GROUP BY 1, 2)"""


def ring_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("node_id"), ((7 * k) % 120 - 60).cast("double").alias("lat"), ((29 * k) % 360 - 180).cast("double").alias("lon"))


RING_NODES_SQL = "nd AS (SELECT n_nationkey::BIGINT AS node_id, ((7 * n_nationkey) % 120 - 60)::DOUBLE AS lat, ((29 * n_nationkey) % 360 - 180)::DOUBLE AS lon FROM nation)"


def ring(spark: SparkSession, sf_dir: str) -> GeoGraph:
    return GeoGraph(ring_edges(spark, sf_dir), ring_nodes(spark, sf_dir))


def lane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade lanes from customer to supplier nations, weighed by quantity; the facts are summed before any join but the
    one by order."""
    t = lambda n: table(spark, sf_dir, n)
    facts = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = facts.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    by = by.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lanes = by.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("q").cast("long").alias("qty"))
    return lanes.select("src", "dst", (1 + F.col("qty") % 97).cast("double").alias("weight"), "qty")


LANE_SQL = """e AS (SELECT src, dst, 1 + qty % 97 AS w, qty FROM (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_quantity)::BIGINT AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over the parts with weights of either sign."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    n = p.count()
    e = p.select("src", F.explode(F.array(2 * F.col("src") + 1, 2 * F.col("src") + 2)).alias("dst")).where(F.col("dst") < n)
    return e.select("src", "dst", ((7 * F.col("dst")) % 11 - 5).cast("double").alias("weight"))


TREE_SQL = "e AS (SELECT p_partkey::BIGINT AS src, (2 * p_partkey + b)::BIGINT AS dst, ((7 * (2 * p_partkey + b)) % 11 - 5)::BIGINT AS w FROM part, (VALUES (1), (2)) AS t(b) WHERE 2 * p_partkey + b < (SELECT count(*) FROM part))"


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one type of event follows another of the same user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return e.where("next is not null").groupBy("event_type", "next").agg(F.count("*").alias("n"))


def places(spark: SparkSession, sf_dir: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """(point_id, lat, lon): made-up coordinates of customers or suppliers."""
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("point_id"), ((k * 37) % 1409 / 10 - 70).alias("lat"), ((k * 91) % 3583 / 10 - 179).alias("lon"))


def places_sql(name: str = "customer", key: str = "c_custkey", to: str = "pt") -> str:
    return f"{to} AS (SELECT {key}::BIGINT AS point_id, ({key} * 37) % 1409 / 10.0::DOUBLE - 70 AS lat, ({key} * 91) % 3583 / 10.0::DOUBLE - 179 AS lon FROM {name})"


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(part_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")))


def sssp_sql(edges: str, seeds: str = "SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT") -> str:
    """Distances d(o, node, d) over e by keyed recursion from seeds (origin, node, distance)."""
    return f"""WITH RECURSIVE {edges}, d(o, node, d) USING KEY (o, node) AS (
  {seeds}
  UNION
  SELECT d.o, e.dst, min(d.d + e.w)::BIGINT FROM d JOIN e ON d.node = e.src
  LEFT JOIN recurring.d AS r ON r.o = d.o AND r.node = e.dst
  WHERE d.d + e.w < coalesce(r.d, 9000000000000000) GROUP BY d.o, e.dst)"""


HAV = "2 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1))) * {r}"


def hav_sql(a: str, b: str, radius: float = 6371) -> str:
    return "(" + HAV.format(a=a, b=b, r=radius) + ")"
