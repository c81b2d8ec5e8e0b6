"""The registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshroute.functions import geodesy
from meshroute.operators import attach, cache, grid, hierarchy, model, paths, relax, routing, simplify, transit
from meshroute.plans import fixtures as fx
from meshroute.session import cut
from meshroute.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def _from(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "origin_id long")


def _tree(dist: DataFrame) -> DataFrame:
    return dist.select("node", F.col("dist").cast("long").alias("dist"))


# ---- Shortest paths

_PART = fx.sssp_sql(fx.PART_SQL) + " SELECT node, d AS dist FROM d"


def _part_query(strategy: str, short: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tree(relax.STRATEGIES[strategy](cut(fx.part_edges(spark, sf_dir)), relax.seeds_of(_from(spark, 0))))

    run.__name__ = f"sssp_{short}"
    query(_PART)(run)


@query(_PART)
def sssp_dijkstra(spark, sf_dir):
    return _tree(relax.relax(cut(fx.part_edges(spark, sf_dir)), relax.seeds_of(_from(spark, 0))))


for _strategy, _short in (("dijkstra_buckets", "buckets"), ("bellman_ford", "bellman_ford"), ("bmssp", "bmssp")):
    _part_query(_strategy, _short)


@query(_PART)
def sssp_kernel(spark, sf_dir):
    return _tree(relax.kernel_trees(fx.part_edges(spark, sf_dir), relax.seeds_of(_from(spark, 0))))


@query(fx.sssp_sql(fx.RING_SQL) + " SELECT node, d AS dist FROM d WHERE node = 13")
def sssp_a_star(spark, sf_dir):
    targets = spark.createDataFrame([(0, 13)], "origin_id long, target long")
    # Edges weigh 1 at least, and no step goes further than 7 round the ring.
    gap = F.abs(F.col("node") - F.col("target"))
    ahead = F.ceil(F.least(gap, 25 - gap) / 7).cast("double")
    dist = relax.a_star(fx.ring_edges(spark, sf_dir), relax.seeds_of(_from(spark, 0)), targets, ahead)
    return _tree(dist.where("node = 13"))


@query(fx.sssp_sql(fx.PART_SQL) + """ SELECT d.node, d.d AS dist, CASE WHEN d.node <> 0 THEN (SELECT arg_min(u.node, u.d * 10000000 + u.node) FROM d AS u JOIN e ON e.src = u.node WHERE e.dst = d.node AND u.d + e.w = d.d) END AS pred FROM d""")
def sssp_tree_pred(spark, sf_dir):
    edges = cut(fx.part_edges(spark, sf_dir))
    start = _from(spark, 0)
    dist = cut(relax.trees(edges, relax.seeds_of(start)))
    tree = relax.predecessors(edges, dist, start.select("origin_id", F.col("origin_id").alias("node")))
    return tree.select("node", F.col("dist").cast("long").alias("dist"), "pred")


@query(fx.sssp_sql(fx.PART_SQL, "SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, 0::BIGINT), (0, 77, 0), (0, 150, 0))") + " SELECT node, d AS dist FROM d")
def sssp_multi_source(spark, sf_dir):
    seeds = spark.createDataFrame([(0, n, 0.0) for n in (3, 77, 150)], "origin_id long, node long, dist double")
    return _tree(relax.relax(cut(fx.part_edges(spark, sf_dir)), seeds))


@query(fx.sssp_sql(fx.PART_SQL, "SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::BIGINT FROM nation") + " SELECT o AS origin_id, node, d AS dist FROM d")
def sssp_batch_origins(spark, sf_dir):
    o = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin_id"))
    return relax.trees(cut(fx.part_edges(spark, sf_dir)), relax.seeds_of(o)).select("origin_id", "node", F.col("dist").cast("long").alias("dist"))


@query(fx.sssp_sql(fx.TREE_SQL) + " SELECT node, d AS dist FROM d")
def sssp_negative_dag(spark, sf_dir):
    return _tree(relax.dijkstra_negative(cut(fx.tree_edges(spark, sf_dir)), relax.seeds_of(_from(spark, 0))))


# All weights but the one that is made negative are positive, so that a negative cycle is that edge and the way back.
@query(f"""WITH {fx.RING_SQL}, g AS (SELECT 'tree' AS graph, * FROM e UNION ALL SELECT 'closed', src, dst, CASE WHEN src = 0 AND dst = 1 THEN -100 ELSE w END FROM e)
SELECT graph, min(a.w + b.w) < 0 AS negative_cycle FROM g AS a JOIN g AS b USING (graph) WHERE a.src = b.dst AND a.dst = b.src GROUP BY 1""")
def negative_cycle_flag(spark, sf_dir):
    e = fx.ring_edges(spark, sf_dir)
    closed = e.select("src", "dst", F.when((F.col("src") == 0) & (F.col("dst") == 1), -100.0).otherwise(F.col("weight")).alias("weight"))
    out = []
    for name, edges in (("tree", e), ("closed", closed)):
        try:
            relax.dijkstra_negative(cut(edges), relax.seeds_of(_from(spark, 0)))
            out.append((name, False))
        except relax.NegativeCycle:
            out.append((name, True))
    return spark.createDataFrame(out, "graph string, negative_cycle boolean")


_RING_ALL = fx.sssp_sql(fx.RING_SQL, "SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::BIGINT FROM nation")
_RING_PATHS = _RING_ALL + """, t AS (SELECT d.o, d.node, CASE WHEN d.node <> d.o THEN (SELECT arg_min(u.node, u.d * 1000 + u.node) FROM d AS u JOIN e ON e.src = u.node WHERE u.o = d.o AND e.dst = d.node AND u.d + e.w = d.d) END AS pred FROM d),
w AS (SELECT o, node AS last, node, 0 AS back FROM t UNION ALL SELECT w.o, w.last, t.pred, w.back + 1 FROM w JOIN t ON t.o = w.o AND t.node = w.node WHERE t.pred IS NOT NULL)"""


def _ring_pairs(spark, sf_dir) -> DataFrame:
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("origin_id"))
    return n.select((F.col("origin_id") * 100 + (F.col("origin_id") * 3 + 5) % 25).alias("query_id"), "origin_id", ((F.col("origin_id") * 3 + 5) % 25).alias("destination_id"))


@query(_RING_PATHS + " SELECT o * 100 + last AS query_id, (max(back) OVER (PARTITION BY o, last) - back)::INT AS seq, node FROM w WHERE last = (o * 3 + 5) % 25")
def tree_path(spark, sf_dir):
    g = fx.ring(spark, sf_dir)
    pairs = _ring_pairs(spark, sf_dir)
    tree = cache.TreeCache(g).ensure(pairs.select("origin_id"))
    return paths.tall_paths(tree, pairs).select("query_id", F.col("seq").cast("int").alias("seq"), "node")


@query(_RING_ALL + " SELECT o * 100 + node AS query_id, d AS length FROM d WHERE node = (o * 3 + 5) % 25")
def cached_lengths(spark, sf_dir):
    return cache.TreeCache(fx.ring(spark, sf_dir)).shortest_paths(_ring_pairs(spark, sf_dir), length_only=True).select("query_id", F.col("length").cast("long").alias("length"))


@query(f"WITH {fx.RING_SQL} SELECT n_nationkey::BIGINT AS query_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE a.w + b.w END AS weight, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS missing FROM nation JOIN e AS a ON a.src = n_nationkey AND a.dst = (n_nationkey + 1) % 25 JOIN e AS b ON b.src = a.dst AND b.dst = (a.dst + 7) % 25")
def path_weight(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    p = fx.table(spark, sf_dir, "nation").select(k.alias("query_id"), F.when(k % 5 == 0, F.array(k, (k + 1) % 25, (k + 3) % 25)).otherwise(F.array(k, (k + 1) % 25, (k + 8) % 25)).alias("path"))
    return paths.path_weights(fx.ring_edges(spark, sf_dir), p).select("query_id", F.col("weight").cast("long").alias("weight"), "missing")


def _h(a: str, b: str, r: float = 6371) -> str:
    return fx.hav_sql(a, b, r)


@query(f"WITH {fx.RING_SQL}, {fx.RING_NODES_SQL}, {fx.places_sql('supplier', 's_suppkey')} SELECT pt.point_id AS query_id, round((a.w + b.w + {_h('pt', 'x')} + {_h('z', 'pt')}) * 0.621371, 4) AS weight FROM pt JOIN e AS a ON a.src = pt.point_id % 25 AND a.dst = (a.src + 1) % 25 JOIN e AS b ON b.src = a.dst AND b.dst = (a.dst + 7) % 25 JOIN nd AS x ON x.node_id = a.src JOIN nd AS z ON z.node_id = b.dst")
def cross_network_path_weight(spark, sf_dir):
    k = F.col("point_id") % 25
    p = fx.places(spark, sf_dir, "supplier", "s_suppkey").select(F.col("point_id").alias("query_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), F.array(k, (k + 1) % 25, (k + 8) % 25).alias("path"))
    return routing.cross_network_weights(fx.ring(spark, sf_dir), p, output_units="mi").select("query_id", F.round("weight", 4).alias("weight"))


# ---- Checks and changes

_REACH = f"WITH RECURSIVE {fx.TREE_SQL}, r(node) AS (SELECT 5::BIGINT UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)"


@query(_REACH + " SELECT node FROM r")
def reachability(spark, sf_dir):
    return relax.reached(cut(fx.tree_edges(spark, sf_dir)), _from(spark, 5)).select("node")


def _apart(first: str) -> str:
    """SQL of f, what `first` reaches over e, and b, what reaches it."""
    return f"f(node) AS ({first} UNION SELECT e.dst FROM f JOIN e ON f.node = e.src), b(node) AS ({first} UNION SELECT e.src FROM b JOIN e ON b.node = e.dst)"


@query(f"WITH RECURSIVE {fx.TREE_SQL}, {_apart('SELECT 5::BIGINT')} SELECT p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT node FROM f) OR p_partkey NOT IN (SELECT node FROM b)")
def strong_connectivity(spark, sf_dir):
    nodes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"))
    return relax.unreached(model.Graph(cut(fx.tree_edges(spark, sf_dir)), nodes), 5)


@query(f"WITH RECURSIVE {fx.LANE_SQL}, {_apart('SELECT min(c_nationkey)::BIGINT FROM customer')}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node AS node_id, node IN (SELECT node FROM f) AND node IN (SELECT node FROM b) AS connected FROM v")
def lane_connectivity(spark, sf_dir):
    g = model.from_edges(cut(fx.lane_edges(spark, sf_dir)))
    first = fx.table(spark, sf_dir, "customer").agg(F.min("c_nationkey")).first()[0]
    gone = relax.unreached(g, first).withColumnRenamed("node_id", "gone")
    return g.nodes.join(gone, F.col("node_id") == F.col("gone"), "left").select("node_id", F.col("gone").isNull().alias("connected"))


@query(f"WITH {fx.LANE_SQL} SELECT a.src, a.dst, a.w AS weight FROM e AS a LEFT JOIN e AS b ON a.src = b.dst AND a.dst = b.src AND a.w = b.w WHERE b.src IS NULL")
def symmetry_violations(spark, sf_dir):
    return model.asymmetric_edges(fx.lane_edges(spark, sf_dir)).select("src", "dst", F.col("weight").cast("long").alias("weight"))


# A tree with a node taken out: edges that hang, weights below nought, no way back.
@query(f"""WITH RECURSIVE {fx.TREE_SQL}, nd AS (SELECT p_partkey::BIGINT AS node_id FROM part WHERE p_partkey <> 3), {_apart('SELECT min(node_id) FROM nd')}
SELECT 'no_nodes' AS rule, (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM nd)::BIGINT AS violations
UNION ALL SELECT 'dangling_edges', (SELECT count(*) FROM e WHERE src NOT IN (SELECT node_id FROM nd)) + (SELECT count(*) FROM e WHERE dst NOT IN (SELECT node_id FROM nd))
UNION ALL SELECT 'negative_or_missing_weights', (SELECT count(*) FROM e WHERE w < 0)
UNION ALL SELECT 'asymmetric_edges', (SELECT count(*) FROM e AS x WHERE NOT EXISTS (SELECT 1 FROM e AS y WHERE y.src = x.dst AND y.dst = x.src AND y.w = x.w))
UNION ALL SELECT 'unreached_nodes', (SELECT count(*) FROM nd WHERE node_id NOT IN (SELECT node FROM f) OR node_id NOT IN (SELECT node FROM b))""")
def validate_report(spark, sf_dir):
    nodes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")).where("node_id <> 3")
    return model.validate(model.Graph(cut(fx.tree_edges(spark, sf_dir)), nodes))


@query(f"WITH {fx.PART_SQL} SELECT dst AS src, src AS dst, w AS weight FROM e")
def inverse_graph(spark, sf_dir):
    return model.inverse(fx.part_edges(spark, sf_dir)).select("src", "dst", F.col("weight").cast("long").alias("weight"))


def _whole(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("weight").cast("long").alias("weight"))


@query(f"WITH {fx.RING_SQL} SELECT src, dst, w AS weight FROM e WHERE NOT (src = 0 AND dst IN (1, 12)) AND NOT (src IN (1, 12) AND dst = 0) UNION ALL SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 50::BIGINT), (1, 0, 50), (0, 12, 9), (12, 0, 9))")
def add_edge(spark, sf_dir):
    g = model.add_edge(fx.ring(spark, sf_dir), 0, 1, 50, symmetric=True)
    return _whole(model.add_edge(g, 0, 12, 9, symmetric=True).edges)


@query(f"WITH {fx.RING_SQL} SELECT src, dst, w AS weight FROM e WHERE NOT (src = 0 AND dst = 1) AND NOT (src = 1 AND dst = 0)")
def remove_edge(spark, sf_dir):
    return _whole(model.remove_edge(fx.ring(spark, sf_dir), 0, 1, symmetric=True)[0].edges)


@query(f"WITH {fx.RING_SQL} SELECT src, dst, w AS weight FROM e UNION ALL SELECT * FROM (VALUES (25::BIGINT, 3::BIGINT, 4::BIGINT), (3, 25, 4))")
def add_node(spark, sf_dir):
    out = spark.createDataFrame([(3, 4.0)], "dst long, weight double")
    return _whole(model.add_node(fx.ring(spark, sf_dir), out, symmetric=True)[0].edges)


@query(f"WITH {fx.RING_SQL} SELECT src, dst, w AS weight FROM e WHERE src <> 24 AND dst <> 24")
def remove_node(spark, sf_dir):
    return _whole(model.remove_last_node(fx.ring(spark, sf_dir))[0].edges)


@query(f"WITH {fx.PART_SQL} SELECT src, string_agg(dst || ':' || w, ',' ORDER BY dst) AS out FROM e GROUP BY 1")
def packed_adjacency(spark, sf_dir):
    out = F.transform("out", lambda x: F.concat(x["dst"].cast("string"), F.lit(":"), x["weight"].cast("long").cast("string")))
    return fx.part_graph(spark, sf_dir).packed().select("src", F.array_join(out, ",").alias("out"))


@query(f"WITH {fx.LANE_SQL} SELECT src, dst, qty, w AS weight FROM e")
def lane_graph_from_orders(spark, sf_dir):
    return fx.lane_edges(spark, sf_dir).select("src", "dst", "qty", F.col("weight").cast("long").alias("weight"))


@query("SELECT event_type, next, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL GROUP BY 1, 2")
def event_transition_graph(spark, sf_dir):
    return fx.event_edges(spark, sf_dir)


@query("SELECT l_partkey AS src, l_suppkey AS dst, min(l_quantity)::BIGINT AS weight FROM lineitem GROUP BY 1, 2")
def parallel_edge_min(spark, sf_dir):
    e = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return _whole(model.lightest(e))


# ---- Geometry

_TWO = f"WITH {fx.places_sql()}, {fx.RING_NODES_SQL} SELECT pt.point_id, nd.node_id, "


def _pairs(spark, sf_dir) -> DataFrame:
    p = fx.places(spark, sf_dir).withColumn("k", F.col("point_id") % 25)
    n = fx.ring_nodes(spark, sf_dir).toDF("node_id", "n_lat", "n_lon")
    return p.join(n, F.col("k") == F.col("node_id"))


@query(_TWO + f"round({_h('pt', 'nd')}, 5) AS km, round({_h('pt', 'nd', 3959)} * 1.2, 5) AS mi FROM pt JOIN nd ON pt.point_id % 25 = nd.node_id")
def haversine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("point_id", "node_id", F.round(geodesy.haversine("lat", "lon", "n_lat", "n_lon"), 5).alias("km"), F.round(geodesy.haversine("lat", "lon", "n_lat", "n_lon", "mi", 1.2), 5).alias("mi"))


@query(f"""WITH {fx.places_sql()}, {fx.RING_NODES_SQL}, k AS (SELECT (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2, pi() / 180 AS rad),
g AS (SELECT pt.point_id, nd.node_id, least(abs(nd.lon - pt.lon), 360 - abs(nd.lon - pt.lon)) AS gap, nd.lat - pt.lat AS up, cos((pt.lat + nd.lat) / 2 * rad) AS c, e2, rad FROM pt JOIN nd ON pt.point_id % 25 = nd.node_id, k),
w AS (SELECT *, 1 / (1 - e2 * (1 - c * c)) AS w2 FROM g) SELECT point_id, node_id, round(sqrt(pow(gap * rad * 6371 * sqrt(w2) * c, 2) + pow(up * rad * 6371 * sqrt(w2) * w2 * (1 - e2), 2)), 5) AS km FROM w""")
def cheap_ruler_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("point_id", "node_id", F.round(geodesy.cheap_ruler("lat", "lon", "n_lat", "n_lon"), 5).alias("km"))


@query("SELECT o_orderkey, round(o_totalprice * 0.621371, 4) AS mi, round(o_totalprice / 3280.84, 4) AS km FROM orders")
def unit_convert(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.round(geodesy.convert("o_totalprice", "km", "mi"), 4).alias("mi"), F.round(geodesy.convert("o_totalprice", "ft", "km"), 4).alias("km"))


@query("SELECT c_custkey, trunc(c_acctbal * 10.0::DOUBLE + CASE WHEN c_acctbal > 0 THEN 0.5 ELSE -0.5 END) / 10 AS rounded FROM customer")
def hard_round(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", geodesy.hard_round(1, "c_acctbal").alias("rounded"))


@query(_TWO + f"round({_h('pt', 'nd')} / 111, 6) AS bound FROM pt JOIN nd ON pt.point_id % 25 = nd.node_id")
def lat_lon_bound(spark, sf_dir):
    return _pairs(spark, sf_dir).select("point_id", "node_id", F.round(geodesy.bound_between("lat", "lon", "n_lat", "n_lon"), 6).alias("bound"))


@query("SELECT c_custkey, round(sign(c_acctbal) * (abs(c_acctbal) % 180), 6) + 0.0 AS wrapped FROM customer")
def coord_wrap(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", (F.round(geodesy.wrap(180, "c_acctbal"), 6) + 0.0).alias("wrapped"))


@query("SELECT p_partkey, (abs((3 - p_size) * (p_partkey % 7 - 1) - (p_partkey % 5 - p_size) * (2 - 1)))::DOUBLE AS area, least(pow(p_size - 3, 2) + pow(1 - 2, 2), pow(3 - p_partkey % 5, 2) + pow(2 - p_partkey % 7, 2))::DOUBLE AS edge FROM part")
def triangle_area(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    c = [F.col("p_size").cast("double"), F.lit(1.0), F.lit(3.0), F.lit(2.0), (F.col("p_partkey") % 5).cast("double"), (F.col("p_partkey") % 7).cast("double")]
    return p.select("p_partkey", geodesy.triangle_area(*c).alias("area"), geodesy.shorter_edge_squared(*c).alias("edge"))


# ---- Attachment


@query(f"WITH {fx.places_sql()}, {fx.RING_NODES_SQL} SELECT point_id, arg_min(node_id, km) AS node_id, round(min(km), 4) AS leg FROM (SELECT point_id, node_id, {_h('pt', 'nd')} AS km FROM pt, nd) GROUP BY 1")
def nearest_node(spark, sf_dir):
    return attach.nearest_node(fx.places(spark, sf_dir), fx.ring_nodes(spark, sf_dir)).select("point_id", "node_id", F.round("leg", 4).alias("leg"))


_BOX = f"""WITH {fx.places_sql()}, {fx.RING_NODES_SQL}, c AS (SELECT point_id, node_id, {_h('pt', 'nd')} AS km, pow(nd.lat - pt.lat, 2) + pow(nd.lon - pt.lon, 2) AS sq,
  CASE WHEN nd.lat > pt.lat THEN 'n' ELSE 's' END || CASE WHEN nd.lon > pt.lon THEN 'e' ELSE 'w' END AS part
  FROM pt JOIN nd ON nd.lat BETWEEN pt.lat - 20 AND pt.lat + 20 AND nd.lon BETWEEN pt.lon - 20 AND pt.lon + 20)"""


def _to_metres(weight: str = "weight") -> F.Column:
    """Kilometres to three places as the SQL rounds them: on the binary value, by which a decimal tie such as 2085.9235 goes
    down. F.round() would take the decimal digits for the value."""
    return geodesy.hard_round(3, weight).alias(weight)


def _attached(spark, sf_dir, method: str, fallback: bool = False) -> DataFrame:
    # The SQL's arg_min leaves open which of equally near nodes it takes; DuckDB joins by latitude, so that the southernmost
    # comes first.
    found = attach.attach(fx.places(spark, sf_dir), fx.ring_nodes(spark, sf_dir), method, bound=20.0, circuity=1.5, fallback=fallback, ties=("lat",))
    return found.select("point_id", "node_id", _to_metres())


@query(_BOX + " SELECT point_id, arg_min(node_id, sq) AS node_id, round(round(arg_min(km, sq) * 1.5, 4), 3) AS weight FROM c GROUP BY 1")
def closest_in_bbox(spark, sf_dir):
    return _attached(spark, sf_dir, "closest")


@query(_BOX + " SELECT point_id, arg_min(node_id, sq) AS node_id, round(round(arg_min(km, sq) * 1.5, 4), 3) AS weight FROM c GROUP BY point_id, part")
def quadrant_nodes(spark, sf_dir):
    return _attached(spark, sf_dir, "quadrant")


@query(_BOX + " SELECT point_id, node_id, round(round(km * 1.5, 4), 3) AS weight FROM c")
def all_in_bbox(spark, sf_dir):
    return _attached(spark, sf_dir, "all")


@query(_BOX + f", o AS (SELECT point_id, arg_min(node_id, km) AS node_id, round(round(min(km) * 1.5, 4), 3) AS weight FROM (SELECT pt.point_id, node_id, {_h('pt', 'nd')} AS km FROM pt, nd WHERE pt.point_id NOT IN (SELECT point_id FROM c)) GROUP BY 1) SELECT point_id, arg_min(node_id, sq) AS node_id, round(round(arg_min(km, sq) * 1.5, 4), 3) AS weight FROM c GROUP BY 1 UNION ALL SELECT * FROM o")
def bbox_fallback(spark, sf_dir):
    return _attached(spark, sf_dir, "closest", fallback=True)


@query(f"WITH {fx.RING_SQL}, {fx.RING_NODES_SQL}, pt AS (SELECT 3.5 AS lat, 10.25 AS lon), c AS (SELECT node_id, {_h('pt', 'nd')} AS km, pow(nd.lat - pt.lat, 2) + pow(nd.lon - pt.lon, 2) AS sq, CASE WHEN nd.lat > pt.lat THEN 'n' ELSE 's' END || CASE WHEN nd.lon > pt.lon THEN 'e' ELSE 'w' END AS part FROM pt, nd WHERE abs(nd.lat - pt.lat) <= 60 AND abs(nd.lon - pt.lon) <= 60), l AS (SELECT arg_min(node_id, sq) AS node_id, round(round(arg_min(km, sq) * 1.2, 4), 3) AS w FROM c GROUP BY part) SELECT src, dst, w::DOUBLE AS weight FROM e UNION ALL SELECT 25, node_id, w FROM l UNION ALL SELECT node_id, 25, w FROM l")
def attach_coord_node(spark, sf_dir):
    g, _ = attach.attach_node(fx.ring(spark, sf_dir), 3.5, 10.25, "quadrant", bound=60.0, circuity=1.2)
    return g.edges.select("src", "dst", _to_metres())


@query(f"""WITH {fx.RING_SQL}, {fx.RING_NODES_SQL}, m AS (SELECT node_id + 25 AS node_id, lat + 0.5 AS lat, lon + 0.5 AS lon FROM nd), pt AS (SELECT s_suppkey::BIGINT AS point_id, (s_suppkey * 37) % 1409 / 10.0::DOUBLE - 70 AS lat, (s_suppkey * 91) % 3583 / 10.0::DOUBLE - 179 AS lon FROM supplier),
k AS (SELECT point_id + 50 AS src, node_id AS dst, round(round({_h('pt', 'nd')} * 1.2, 4), 3) AS w, row_number() OVER (PARTITION BY point_id ORDER BY pow(nd.lat - pt.lat, 2) + pow(nd.lon - pt.lon, 2)) AS rn FROM pt, nd WHERE abs(nd.lat - pt.lat) <= 90 AND abs(nd.lon - pt.lon) <= 90
 UNION ALL SELECT point_id + 50, node_id, round(round({_h('pt', 'm')} * 1.2, 4), 3), row_number() OVER (PARTITION BY point_id ORDER BY pow(m.lat - pt.lat, 2) + pow(m.lon - pt.lon, 2)) FROM pt, m WHERE abs(m.lat - pt.lat) <= 90 AND abs(m.lon - pt.lon) <= 90)
SELECT src, dst, w::DOUBLE AS weight FROM e UNION ALL SELECT src + 25, dst + 25, w FROM e UNION ALL SELECT src, dst, w FROM k WHERE rn = 1 UNION ALL SELECT dst, src, w FROM k WHERE rn = 1""")
def merge_networks(spark, sf_dir):
    a = fx.ring(spark, sf_dir)
    b = a.with_(nodes=a.nodes.select("node_id", (F.col("lat") + 0.5).alias("lat"), (F.col("lon") + 0.5).alias("lon")))
    ports = fx.places(spark, sf_dir, "supplier", "s_suppkey")
    return attach.merge(a, b, ports, bound=90.0).edges.select("src", "dst", _to_metres())


# ---- Routes

_ENTRY = f"nn AS (SELECT point_id, arg_min(node_id, km) AS node_id, min(km) AS leg FROM (SELECT point_id, node_id, {_h('pt', 'nd')} AS km FROM pt, nd) GROUP BY 1)"
_MATRIX = _RING_ALL + f", {fx.RING_NODES_SQL}, {fx.places_sql('supplier', 's_suppkey')}, {_ENTRY}"


@query(_MATRIX + f" SELECT a.point_id AS query_id, round(CASE WHEN na.node_id = nb.node_id THEN {_h('a', 'b')} ELSE d.d + na.leg + nb.leg END, 4) AS length FROM pt AS a JOIN pt AS b ON b.point_id = (a.point_id * 7 + 3) % (SELECT count(*) FROM pt) JOIN nn AS na ON na.point_id = a.point_id JOIN nn AS nb ON nb.point_id = b.point_id JOIN d ON d.o = na.node_id AND d.node = nb.node_id")
def route_lengths(spark, sf_dir):
    return routing.route(fx.ring(spark, sf_dir), _trips(spark, sf_dir), length_only=True).select("query_id", F.round("length", 4).alias("length"))


def _trips(spark, sf_dir) -> DataFrame:
    p = fx.places(spark, sf_dir, "supplier", "s_suppkey")
    n = p.count()
    to = p.toDF("t_id", "d_lat", "d_lon")
    return p.join(to, (F.col("point_id") * 7 + 3) % n == F.col("t_id")).select(F.col("point_id").alias("query_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "d_lat", "d_lon")


@query(_MATRIX + " SELECT a.point_id AS i, b.point_id AS j, round(CASE WHEN a.node_id = b.node_id THEN 0 ELSE d.d + a.leg + b.leg END, 4) AS distance FROM nn AS a, nn AS b, d WHERE d.o = a.node_id AND d.node = b.node_id")
def distance_matrix(spark, sf_dir):
    return routing.distance_matrix(fx.ring(spark, sf_dir), fx.places(spark, sf_dir, "supplier", "s_suppkey")).select("i", "j", geodesy.hard_round(4, "distance").alias("distance"))


@query(_MATRIX + " SELECT a.point_id AS i, count(*) AS n, round(sum(CASE WHEN a.node_id = b.node_id THEN 0 ELSE d.d + a.leg + b.leg END), 2) AS total FROM nn AS a, nn AS b, d WHERE d.o = a.node_id AND d.node = b.node_id GROUP BY 1")
def distance_matrix_dense(spark, sf_dir):
    m = routing.dense_rows(fx.ring(spark, sf_dir), fx.places(spark, sf_dir, "supplier", "s_suppkey"))
    return m.select("i", F.size("row").cast("long").alias("n"), F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(f"""{fx.sssp_sql(fx.PART_SQL + ", " + fx.places_sql("part", "p_partkey", "nd0") + ", nd AS (SELECT point_id AS node_id, lat, lon FROM nd0), " + fx.places_sql("supplier", "s_suppkey") + ", " + _ENTRY, "SELECT DISTINCT node_id, node_id, 0::BIGINT FROM nn")}
SELECT a.point_id AS i, b.point_id AS j, round(CASE WHEN a.node_id = b.node_id THEN 0 ELSE d.d + a.leg + b.leg END, 4) AS distance FROM nn AS a, nn AS b, d WHERE d.o = a.node_id AND d.node = b.node_id""")
def distance_matrix_parts(spark, sf_dir):
    """All pairs of suppliers over the network of parts, which grows with the scale factor."""
    g = model.GeoGraph(cut(fx.part_edges(spark, sf_dir)), fx.places(spark, sf_dir, "part", "p_partkey").withColumnRenamed("point_id", "node_id"))
    return routing.distance_matrix(g, fx.places(spark, sf_dir, "supplier", "s_suppkey")).select("i", "j", geodesy.hard_round(4, "distance").alias("distance"))


@query(fx.sssp_sql(fx.PART_SQL, "SELECT s_suppkey::BIGINT, s_suppkey::BIGINT, 0::BIGINT FROM supplier") + " SELECT o AS origin_id, count(*) AS reached, sum(d)::BIGINT AS total, max(d)::BIGINT AS furthest FROM d GROUP BY 1")
def tree_sums(spark, sf_dir):
    """A whole tree over the network of parts for each supplier's key."""
    o = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("origin_id"))
    sums = relax.tree_sums(cut(fx.part_edges(spark, sf_dir)), relax.seeds_of(o))
    return sums.select("origin_id", "reached", F.col("total").cast("long").alias("total"), F.col("furthest").cast("long").alias("furthest"))


@query(fx.sssp_sql(fx.PART_SQL, "SELECT s_suppkey::BIGINT, s_suppkey::BIGINT, 0::BIGINT FROM supplier") + " SELECT o AS query_id, d AS length FROM d WHERE node = (o * 13 + 7) % (SELECT n FROM n)")
def part_paths(spark, sf_dir):
    """Paths over the network of parts, their lengths summed up again edge by edge."""
    g = fx.part_graph(spark, sf_dir)
    n = g.size()
    pairs = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("origin_id"), ((F.col("s_suppkey") * 13 + 7) % n).alias("destination_id"))
    got = cut(routing.shortest_paths(g, pairs).where("length is not null").select("query_id", "path"))
    return paths.path_weights(g.edges, got).select("query_id", F.col("weight").cast("long").alias("length"))


@query()
def route_coordinates(spark, sf_dir):
    return routing.route(fx.ring(spark, sf_dir), _trips(spark, sf_dir), form="list_of_lists_long_first")


@query()
def route_attached(spark, sf_dir):
    return routing.route(fx.ring(spark, sf_dir), _trips(spark, sf_dir), origin_method="quadrant", destination_method="closest", bound=30.0)


# ---- Grids

_CELLS = "SELECT x::BIGINT AS x, y::BIGINT AS y FROM range(30) AS a(x), range(20) AS b(y)"
# Moves of a one-cell body: a straight move sweeps its two cells, a diagonal one the four of its square.
_GRID = f"""c AS ({_CELLS}), bl AS (SELECT x, y FROM c WHERE x IN (0, 29) OR y IN (0, 19) OR (x = 12 AND y >= 5) OR ((x * 7 + y * 11) % 13 = 0 AND x > 15)),
mv(dx, dy, w) AS (VALUES (0, 1, 10000), (1, 0, 10000), (0, -1, 10000), (-1, 0, 10000), (1, 1, 14142), (1, -1, 14142), (-1, 1, 14142), (-1, -1, 14142)),
e AS (SELECT x + 30 * y AS src, (x + dx) + 30 * (y + dy) AS dst, w::BIGINT AS w FROM c, mv WHERE x + dx BETWEEN 0 AND 29 AND y + dy BETWEEN 0 AND 19
  AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.x IN (c.x, c.x + dx) AND bl.y IN (c.y, c.y + dy)))"""


def _grid(spark, sf_dir) -> grid.Grid:
    at = grid.cells(spark, 30, 20)
    return grid.build(spark, 30, 20, at.where("(x = 12 and y >= 5) or ((x * 7 + y * 11) % 13 = 0 and x > 15)").select("x", "y"))


def _cost(c) -> F.Column:
    return F.round(c * 10000).cast("long")


@query(f"WITH {_GRID} SELECT src, dst, w AS cost FROM e")
def grid_edges(spark, sf_dir):
    return _grid(spark, sf_dir).graph.edges.select("src", "dst", _cost(F.col("weight")).alias("cost"))


@query(f"WITH {_GRID} SELECT x + 30 * y AS src, (x + dx) + 30 * (y + dy) AS dst FROM c, mv WHERE x + dx BETWEEN 0 AND 29 AND y + dy BETWEEN 0 AND 19 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = x + 30 * y AND e.dst = (x + dx) + 30 * (y + dy))")
def grid_blocked_moves(spark, sf_dir):
    return grid.blocked_moves(_grid(spark, sf_dir))


@query(fx.sssp_sql(_GRID, "SELECT 0::BIGINT, 451::BIGINT, 0::BIGINT") + " SELECT node, d AS cost FROM d")
def grid_sssp(spark, sf_dir):
    return relax.kernel_trees(_grid(spark, sf_dir).graph.edges, relax.seeds_of(_from(spark, 451))).select("node", _cost(F.col("dist")).alias("cost"))


@query(f"""WITH {_GRID}, p AS (SELECT s_suppkey::BIGINT AS point_id, 1 + (s_suppkey * 13) % 270 / 10.0::DOUBLE AS x, 1 + (s_suppkey * 7) % 170 / 10.0::DOUBLE AS y FROM supplier),
k(o, dx, dy) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)),
s AS (SELECT point_id, floor(x)::BIGINT + dx + 30 * (floor(y)::BIGINT + dy) AS cell, sqrt(pow(x - floor(x) - dx, 2) + pow(y - floor(y) - dy, 2)) AS leg, o, x = floor(x) AND y = floor(y) AS lattice FROM p, k)
SELECT p.point_id, m.node_id, round(m.leg, 6) AS leg FROM p LEFT JOIN (SELECT point_id, arg_min(cell, leg * 1000000 + o) AS node_id, min(leg) AS leg FROM s WHERE (lattice AND o = 0) OR (NOT lattice AND cell IN (SELECT src FROM e)) GROUP BY 1) AS m USING (point_id)""")
def grid_snap(spark, sf_dir):
    k = F.col("s_suppkey")
    p = fx.table(spark, sf_dir, "supplier").select(k.alias("point_id"), (1 + (k * 13) % 270 / 10).alias("x"), (1 + (k * 7) % 170 / 10).alias("y"))
    return grid.snap(_grid(spark, sf_dir), p).select("point_id", "node_id", F.round("leg", 6).alias("leg"))


@query()
def grid_routes(spark, sf_dir):
    q = spark.createDataFrame([(0, 1.0, 15.0, 25.0, 15.0), (1, 1.5, 2.25, 3.0, 3.0)], "query_id long, ox double, oy double, dx double, dy double")
    return grid.route(_grid(spark, sf_dir), q, form="list_of_lists")


# ---- Lines


def _tracks(spark, sf_dir) -> DataFrame:
    """Each user's events as a line: x the order of the event, y its value."""
    e = fx.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("line_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), (F.floor("value") % 30).cast("double").alias("x"), (F.floor(F.col("value") / 30) % 2).cast("double").alias("y"))


_TRACKS = "tr AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (floor(value) % 30)::DOUBLE AS x, (floor(value / 30) % 2)::DOUBLE AS y FROM events)"
_CLEAN = _TRACKS + ", cl AS (SELECT * EXCLUDE (n, px, py) FROM (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tr WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y) WHERE n > 1)"


@query(f"WITH {_CLEAN} SELECT line_id, seq::INT AS seq, x, y FROM cl")
def line_dedupe(spark, sf_dir):
    return simplify.clean_lines(_tracks(spark, sf_dir)).select("line_id", F.col("seq").cast("int").alias("seq"), "x", "y")


@query(f"""WITH {_TRACKS}, sg AS (SELECT y AS lat, x AS lon, lead(y) OVER w AS lat2, lead(x) OVER w AS lon2 FROM tr WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
a AS (SELECT DISTINCT lat, lon, lat2, lon2 FROM sg WHERE lat2 IS NOT NULL AND (lat <> lat2 OR lon <> lon2)), bw AS (SELECT * FROM a UNION SELECT lat2, lon2, lat, lon FROM a)
SELECT p.lat, p.lon, p.lat2, p.lon2, round({_h('x', 'z')}, 3) AS weight FROM bw AS p, LATERAL (SELECT p.lat AS lat, p.lon AS lon) AS x, LATERAL (SELECT p.lat2 AS lat, p.lon2 AS lon) AS z""")
def line_segments(spark, sf_dir):
    g = files.graph_of_lines(_tracks(spark, sf_dir))
    n = cut(g.nodes)
    e = g.edges.join(n.toDF("a_id", "lat", "lon"), F.col("src") == F.col("a_id")).join(n.toDF("b_id", "lat2", "lon2"), F.col("dst") == F.col("b_id"))
    return e.select("lat", "lon", "lat2", "lon2", "weight")


@query()
def visvalingam(spark, sf_dir):
    return simplify.simplify_lines(simplify.clean_lines(_tracks(spark, sf_dir)), 50, 3)


@query(f"""WITH {fx.RING_SQL}, {fx.RING_NODES_SQL} SELECT src, dst, '{{"type":"Feature","properties":{{"origin_idx":' || src || ',"destination_idx":' || dst || ',"distance":' || w::DOUBLE || '}},"geometry":{{"type":"LineString","coordinates":[[' || a.lon || ',' || a.lat || '],[' || b.lon || ',' || b.lat || ']]}}}}' AS value
FROM e JOIN nd AS a ON a.node_id = src JOIN nd AS b ON b.node_id = dst""")
def geojson_edges(spark, sf_dir):
    return files.geojson_features(fx.ring(spark, sf_dir))


# Metres with two decimals, as km to three places, halves up.
@query("SELECT l_suppkey AS u, l_partkey AS v, (round(min(l_extendedprice) * 100)::BIGINT + 50) // 100 / 1000.0::DOUBLE AS weight FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def osm_graph(spark, sf_dir):
    t = lambda n: fx.table(spark, sf_dir, n)
    ids = t("part").select(F.col("p_partkey").alias("osmid")).union(t("supplier").select("s_suppkey")).distinct()
    nodes = ids.select("osmid", (F.col("osmid") % 3583 / 10 - 179).alias("x"), (F.floor(F.col("osmid") / 3583) / 10 - 70).alias("y"))
    edges = t("lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_extendedprice").alias("length"))
    g = files.from_osm(nodes, edges, shapes=False)
    back = cut(g.nodes.select("node_id", (F.round((F.col("lon") + 179) * 10) + 3583 * F.round((F.col("lat") + 70) * 10)).cast("long").alias("osmid")))
    e = g.edges.join(back.toDF("a", "u"), F.col("src") == F.col("a")).join(back.toDF("b", "v"), F.col("dst") == F.col("b"))
    return e.select("u", "v", F.round("weight", 3).alias("weight"))


# ---- Indexes


@query(_RING_ALL + " SELECT o * 100 + node AS query_id, d AS length FROM d WHERE node = (o * 3 + 5) % 25")
def ch_query_lengths(spark, sf_dir):
    index = hierarchy.build(fx.ring(spark, sf_dir))
    return hierarchy.distances(index, _ring_pairs(spark, sf_dir)).select("query_id", F.col("length").cast("long").alias("length"))


@query(_RING_ALL + " SELECT o * 100 + node AS query_id, d AS length FROM d WHERE node = (o * 3 + 5) % 25")
def tnr_query_lengths(spark, sf_dir):
    index = transit.build(hierarchy.build(fx.ring(spark, sf_dir)), 5)
    return transit.distances(index, _ring_pairs(spark, sf_dir)).select("query_id", F.col("length").cast("long").alias("length"))


@query("SELECT n_nationkey::BIGINT AS node_id, 0::BIGINT AS wrong FROM nation")
def ch_upward_edges_valid(spark, sf_dir):
    """For each node, how many of its edges don't lead up, or aren't as long as some way between their ends: none. Of the
    core, whose edges are upward both ways, one of each two leads up."""
    g = fx.ring(spark, sf_dir)
    index = hierarchy.build(g)
    own = cut(index.up.select("src", "dst", "weight", F.lit(True).alias("there")).unionByName(index.down.select("src", "dst", "weight", F.lit(False).alias("there"))))
    rank = index.rank.select(F.col("node_id").alias("r_id"), "rank")
    e = own.join(rank.toDF("s_id", "s_rank"), F.col("src") == F.col("s_id"), "left").join(rank.toDF("d_id", "d_rank"), F.col("dst") == F.col("d_id"), "left")
    core = index.up.select(F.col("src").alias("k_src"), F.col("dst").alias("k_dst")).intersect(index.up.select("dst", "src"))
    e = e.join(core, (F.col("src") == F.col("k_src")) & (F.col("dst") == F.col("k_dst")), "left")
    dist = relax.trees(g.edges, relax.seeds_of(g.nodes, "node_id"))
    a, b = F.when(F.col("there"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("there"), F.col("dst")).otherwise(F.col("src"))
    e = e.select("src", "weight", "s_rank", "d_rank", F.col("k_src").isNotNull().alias("core"), a.alias("a"), b.alias("b"))
    e = e.join(dist, (F.col("a") == F.col("origin_id")) & (F.col("b") == F.col("node")), "left")
    ok = F.coalesce(F.col("core") | (F.col("s_rank") < F.col("d_rank")), F.lit(False)) & F.coalesce(F.col("weight") >= F.col("dist"), F.lit(False))
    bad = e.where(~ok).groupBy(F.col("src").alias("w_src")).agg(F.count("*").alias("n"))
    return index.rank.join(bad, F.col("node_id") == F.col("w_src"), "left").select("node_id", F.coalesce("n", F.lit(0).cast("long")).alias("wrong"))
