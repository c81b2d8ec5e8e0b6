"""What only came to light on larger tables: queries over tables of a few chosen keys."""

import math

import numpy as np
import pytest

from meshroute.operators import attach, kernel, model, relax, routing
from meshroute.operators.model import GeoGraph
from meshroute.plans import catalogue


def tables(spark, folder, **keys):
    """A folder with the table of nations and tables of these keys alone."""
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    for name, (key, values) in keys.items():
        spark.createDataFrame([(v,) for v in values], f"{key} long").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_bbox_fallback_rounds_as_its_sql(spark, tmp_path):
    """2085.9235 and 8301.1395 lie below their decimal digits."""
    d = tables(spark, tmp_path, customer=("c_custkey", [2114, 4911, 5849]))
    got = {r.point_id: (r.node_id, r.weight) for r in catalogue.queries()["bbox_fallback"](spark, d).collect()}
    assert got == {2114: (9, 2085.923), 4911: (17, 8301.139), 5849: (7, 4170.1)}


def test_closest_in_bbox_takes_the_southern_of_equally_near_nodes(spark, tmp_path):
    d = tables(spark, tmp_path, customer=("c_custkey", [9033, 36797, 50554, 54998]))
    got = {r.point_id: r.node_id for r in catalogue.queries()["closest_in_bbox"](spark, d).collect()}
    assert got == {9033: 18, 36797: 19, 50554: 24, 54998: 22}


def test_grid_snap_by_order_where_legs_differ_in_the_last_digit(spark, tmp_path):
    d = tables(spark, tmp_path, supplier=("s_suppkey", [207, 371, 392, 656]))
    got = {r.point_id: r.node_id for r in catalogue.queries()["grid_snap"](spark, d).collect()}
    assert got == {207: 297, 371: 174, 392: 114, 656: 46}


def web(n):
    """Edges like those of the parts: whole weights, low diameter."""
    return [(s, t, float(w)) for p in range(n) for s, t, w in ((p, 2 * p % n, 1 + 7 * p % 10), (p, (2 * p + 1) % n, 1 + (7 * p + 13) % 10), (p, (p + 1) % n, 1 + (7 * p + 26) % 10))]


def packed(edges):
    best = {}
    for a, b, w in edges:
        best[a, b] = min(w, best.get((a, b), math.inf))
    return kernel.Adjacency(*map(np.array, zip(*((a, b, w) for (a, b), w in best.items()), strict=True)))


def test_tree_sums_without_trees(spark, monkeypatch):
    """A worker gives one row for each origin, and takes many origins in a search by levels."""
    rows = [*web(500), (700, 701, 3.0)]
    graph = packed(rows)
    starts = [{k: 0.0} for k in range(70)] + [{3: 0.0, 9: 2.0}]
    want = [(int(np.isfinite(d).sum()), d[np.isfinite(d)].sum(), d[np.isfinite(d)].max()) for d in (graph_by_heap(graph, s) for s in starts)]
    assert graph.by_levels and list(graph.sums(starts)) == want and graph.by_levels
    monkeypatch.setattr(graph, "heap", None)
    monkeypatch.setattr(graph, "rounds", None)
    assert all((a == graph_by_heap(packed(rows), s)).all() for a, s in zip(graph.distances(starts), starts, strict=True))
    some = np.array([5, 4, -1, 77])
    assert [d.tolist() for d in graph.distances(starts[:2], some)] == [[graph_by_heap(packed(rows), s)[p] if p >= 0 else math.inf for p in some] for s in starts[:2]]
    monkeypatch.undo()
    long = kernel.Adjacency(np.arange(3000), np.arange(1, 3001), np.full(3000, 9.0))
    assert list(long.sums([{0: 0.0}])) == [(3001, 9.0 * 3000 * 3001 / 2, 27000.0)] and not long.by_levels
    hub = packed([(k, 50 + k % 2, 2.0) for k in range(40)] + [(50, 1, 1.0), (51, 2, 1.0)])  # targets with more edges than LAYERS
    starts = [{k: 0.0} for k in range(40)]
    assert all((a == graph_by_heap(hub, s)).all() for a, s in zip(hub.distances(starts), starts, strict=True))
    seeds = spark.createDataFrame([(1, 1, 0.0), (2, 900, 0.0), (3, 700, 1.0)], "origin_id long, node long, dist double")
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {r.origin_id: tuple(r)[1:] for r in relax.tree_sums(edges, seeds).collect()}
    assert got[2] == (1, 0.0, 0.0) and got[3] == (2, 5.0, 4.0) and got[1] == want[1]
    monkeypatch.setattr(relax, "KERNEL_EDGES", 1)
    assert {r.origin_id: tuple(r)[1:] for r in relax.tree_sums(edges, seeds.where("origin_id > 1")).collect()} == {k: got[k] for k in (2, 3)}


def graph_by_heap(graph, seeds):
    dist = np.full(len(graph.ids), np.inf)
    for at, d in graph.heap(list(seeds.items())).items():
        dist[at] = d
    return dist


def test_paths_from_both_ends(monkeypatch):
    """The way and the distance that a whole tree gives, bit for bit, out of two small searches."""
    rnd = np.random.default_rng(5)
    for weight in (rnd.integers(1, 5, 4000).astype(float), rnd.uniform(0.1, 3, 4000)):
        graph = kernel.Adjacency(rnd.integers(0, 1500, 4000), rnd.integers(0, 1500, 4000), weight)
        for seeds in ({3: 0.0}, {3: 0.5, 700: 0.0, 701: 9.0}):
            tree = graph_by_heap(graph, seeds)
            assert not np.isfinite(tree).all()
            for goal in [*range(0, len(tree), 7), 3, 700]:
                way = graph.between(seeds, goal)
                assert way is None if tree[goal] == math.inf else way == (tree[goal], graph.way_back(tree, seeds, goal))


def test_one_goal_needs_no_tree(spark, monkeypatch):
    monkeypatch.setattr(kernel, "SMALL", 0)
    edges = spark.createDataFrame(web(300), "src long, dst long, weight double")
    seeds = spark.createDataFrame([(k, k, 0.0) for k in range(20)], "origin_id long, node long, dist double")
    goals = spark.createDataFrame([(k, (13 * k + 7) % 300) for k in range(20)], "origin_id long, target long")
    tree = packed(web(300))
    for r in kernel.kernel_paths(edges, seeds, goals).collect():
        dist = graph_by_heap(tree, {r.origin_id: 0.0})
        assert r.dist == dist[r.target] and r.path == tree.way_back(dist, {r.origin_id: 0.0}, r.target)


def exchanged(df):
    """How many exchanges the plan has, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_matrix_without_gathering_its_pairs(spark):
    """Rows come out of the task that has their tree: nothing but the points is exchanged, and no pair is written on the way."""
    n = 200
    nodes = spark.createDataFrame([(k, (k * 37 % 1409) / 10 - 70, (k * 91 % 3583) / 10 - 179) for k in range(n)], "node_id long, lat double, lon double")
    g = GeoGraph(spark.createDataFrame([*web(n), (900, 901, 2.0)], "src long, dst long, weight double"), nodes.union(spark.createDataFrame([(900, 89.0, 3.0), (950, -89.0, 3.0)], nodes.schema)))
    at = [(k, (k * 37 % 1409) / 10 - 70, (k * 91 % 3583) / 10 - 179 + 0.01 * (k % 3)) for k in range(0, n, 7)]
    at += [(400, *at[3][1:]), (401, 89.0, 3.5), (402, -89.0, 3.0)]
    points = spark.createDataFrame(at[::-1], "point_id long, lat double, lon double")
    m = routing.distance_matrix(g, points, output_units="mi")
    assert exchanged(m) == 1
    leg = {r.point_id: (r.node_id, r.leg) for r in attach.nearest_node(points, g.nodes, "mi").collect()}
    tree = packed([*web(n), (900, 901, 2.0)])
    want = {}
    for i, (a, a_leg) in leg.items():
        dist = graph_by_heap(tree, {tree.place(a): 0.0}) if tree.place(a) >= 0 else np.full(n + 2, math.inf)
        for j, (b, b_leg) in leg.items():
            far = dist[tree.place(b)] if tree.place(b) >= 0 else math.inf
            want[i, j] = 0.0 if a == b else far * 0.621371 + a_leg + b_leg if far < math.inf else None
    got = {(r.i, r.j): r.distance for r in m.collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert len(got) == len(at) ** 2
    dense = routing.dense_rows(g, points, output_units="mi")
    assert exchanged(dense) == 1
    assert {r.i: r.row for r in dense.collect()} == {i: [want[i, j] for j in sorted(leg)] for i in leg} == {r.i: r.row for r in routing.dense_matrix(m).collect()}


@pytest.mark.parametrize("name", ["dijkstra", "buckets", "bmssp", "multi_source", "reached", "unreached", "validate"])
def test_rounds_broadcast_nothing(spark, monkeypatch, name):
    """What is broadcast passes through the driver, in each round again."""
    rows = web(12)
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    seeds = spark.createDataFrame([(0, k, 0.0) for k in ((3, 7) if name == "multi_source" else (3,))], "origin_id long, node long, dist double")
    graph = model.Graph(edges.localCheckpoint(), spark.range(13).toDF("node_id").localCheckpoint())
    plans = []
    plain = relax.cut
    monkeypatch.setattr(relax, "cut", lambda df: plans.append(df) or plain(df))
    if name == "reached":
        assert relax.reached(graph.edges, seeds.select("origin_id")).count() == 12
    elif name in ("unreached", "validate"):
        out = relax.unreached(graph, 0) if name == "unreached" else model.validate(graph)
        assert name != "unreached" or [r.node_id for r in out.collect()] == [12]
        plans.append(out)
    else:
        search = {"buckets": relax.dijkstra_buckets, "bmssp": relax.bmssp}.get(name, relax.relax)
        got = {r.node: r.dist for r in search(graph.edges, seeds).collect()}
        tree = packed(rows)
        assert got == dict(enumerate(graph_by_heap(tree, {r.node: 0.0 for r in seeds.collect()}).tolist()))
    assert len(plans) > 3 and not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
