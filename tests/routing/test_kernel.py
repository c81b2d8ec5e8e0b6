import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshroute.operators import attach, hierarchy, kernel, model, nearest, relax, routing, transit
from meshroute.operators.model import GeoGraph
from meshroute.sources import files


def plain(edges, seeds):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    dist, heap = {}, [(d, n) for n, d in seeds]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for b, w in out.get(n, ()):
                heapq.heappush(heap, (d + w, b))
    return dist


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def net(spark):
    """300 places, joined with some near ones, and two apart from them."""
    rnd = random.Random(4)
    at = {i: (rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(300)} | {900: (0.0, 0.0), 901: (1.0, 1.0)}
    edges = {}
    for i in range(300):
        for j in sorted(range(300), key=lambda j: km(at[i], at[j]))[1:4]:
            edges[i, j] = km(at[i], at[j]) * rnd.uniform(1, 1.5)
            if rnd.random() < 0.8:
                edges[j, i] = km(at[i], at[j]) * rnd.uniform(1, 1.5)
    edges[900, 901] = 200.0
    rows = [(a, b, w) for (a, b), w in edges.items()]
    g = GeoGraph(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.createDataFrame([(i, *p) for i, p in at.items()] + [(950, 5.0, 5.0)], "node_id long, lat double, lon double"))
    return g, rows, at


@pytest.fixture(scope="module")
def small(spark):
    """30 places of a lattice with two ways between neighbours, and one apart."""
    rnd = random.Random(6)
    at = {x + 6 * y: (float(y), float(x)) for x in range(6) for y in range(5)} | {900: (20.0, 20.0)}
    rows = [(a, b, km(at[a], at[b]) * rnd.uniform(1, 1.6)) for a in range(30) for b in range(30) if abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) == 1]
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "node_id long, lat double, lon double").cache()
    return GeoGraph(spark.createDataFrame(rows, "src long, dst long, weight double").cache(), nodes), rows, at


def test_trees(spark, net):
    g, rows, _ = net
    seeds = [(1, 1, 0.0), (2, 7, 3.0), (2, 50, 0.5), (3, 900, 0.0), (4, 12345, 1.0)]
    want = {(o, n): d for o in (1, 2, 3, 4) for n, d in plain(rows, [(n, d) for k, n, d in seeds if k == o]).items()}
    table = spark.createDataFrame(seeds, "origin_id long, node long, dist double")
    for deep in (False, True):
        most, kernel.ROUNDS = kernel.ROUNDS, -1 if deep else kernel.ROUNDS
        got = {(r.origin_id, r.node): r.dist for r in kernel.kernel_trees(g.edges, table).collect()}
        kernel.ROUNDS = most
        assert got == want
    assert {(r.origin_id, r.node): r.dist for r in relax.relax(g.edges, table).collect()} == want
    keep = spark.createDataFrame([(1,), (50,), (900,), (12345,)], "node long")
    got = {(r.origin_id, r.node): r.dist for r in kernel.kernel_trees(g.edges, table, keep).collect()}
    assert got == {(o, n): want.get((o, n)) for o in (1, 2, 3, 4) for n in (1, 50, 900, 12345)}


def test_rounds_and_heap_agree():
    rnd = np.random.default_rng(1)
    src, dst = rnd.integers(0, 400, 1500), rnd.integers(0, 400, 1500)
    graph = kernel.Adjacency(src, dst, rnd.integers(1, 9, 1500).astype(float))
    dist = np.full((len(graph.ids), 5), np.inf)
    dist[np.arange(5), np.arange(5)] = 0
    assert graph.rounds(dist)
    for k in range(5):
        done = graph.heap([(k, 0.0)])
        assert {i: d for i, d in enumerate(dist[:, k]) if d < np.inf} == done
    hub = kernel.Adjacency(np.r_[src, np.arange(1, 400)], np.r_[dst, np.zeros(399, int)], np.r_[rnd.integers(1, 9, 1500), np.full(399, 2)].astype(float))
    far = np.full((len(hub.ids), 3), np.inf)
    far[[5, 6, 7], [0, 1, 2]] = 0
    assert hub.rounds(far) and len(hub.layers()) == kernel.LAYERS + 1
    for k in range(3):
        before: dict[int, int] = {}
        done = hub.heap([(5 + k, 0.0)], previous=before)
        assert {i: d for i, d in enumerate(far[:, k]) if d < np.inf} == done
        for goal in (0, 17, 300):
            way = [goal]
            while way[-1] in before:
                way.append(before[way[-1]])
            assert goal not in done or hub.way_back(np.ascontiguousarray(far[:, k]), {5 + k: 0.0}, goal) == way[::-1]
    assert not graph.rounds(np.where(np.arange(len(graph.ids))[:, None] == 0, 0.0, np.inf), 1)


@pytest.mark.parametrize("strategy,options", [("dijkstra", {}), ("a_star", {}), ("a_star", {"heuristic": "cheap_ruler"}), ("dijkstra_buckets", {}), ("bmssp", {})])
def test_shortest_paths(spark, small, strategy, options):
    g, rows, _ = small
    pairs = [(k, k * 13 % 30, k * 23 % 30) for k in range(12)] + [(101, 900, 3), (102, 5, 900), (103, 900, 900), (104, 7, 7)]
    got = {r.query_id: r for r in routing.shortest_paths(g, spark.createDataFrame(pairs, "query_id long, origin_id long, destination_id long"), strategy, **options).collect()}
    weight = {(a, b): w for a, b, w in rows}
    for q, a, b in pairs:
        want = plain(rows, [(a, 0.0)]).get(b)
        r = got[q]
        if want is None:
            assert r.length is None and r.path is None
        else:
            assert r.length == pytest.approx(want) and r.path[0] == a and r.path[-1] == b
            assert sum(weight[e] for e in zip(r.path, r.path[1:], strict=False)) == pytest.approx(want)
    with pytest.raises(ValueError):
        routing.shortest_paths(g, spark.createDataFrame([(0, 1, 77777)], "query_id long, origin_id long, destination_id long"), strategy)
    assert len(got) == len(pairs)


def test_star_in_rounds(spark, small, monkeypatch):
    """A* for graphs that don't fit, and with it the trees of the loop."""
    g, rows, _ = small
    pairs = spark.createDataFrame([(0, 3, 14), (1, 3, 27), (2, 5, 900)], "query_id long, origin_id long, destination_id long")
    want = {r.query_id: r.length for r in routing.shortest_paths(g, pairs).collect()}
    monkeypatch.setattr(kernel, "KERNEL_EDGES", 10)
    monkeypatch.setattr(relax, "KERNEL_EDGES", 10)
    for name in ("a_star", "dijkstra"):
        got = {r.query_id: r.length for r in routing.shortest_paths(g, pairs, name).collect()}
        assert got == want
    with pytest.raises(ValueError):
        kernel.kernel_trees(g.edges, relax.seeds_of(pairs))


def test_a_star_settles_less():
    """The bound leads to the target: fewer nodes are settled on the way."""
    side = 30
    at = lambda x, y: x * side + y
    e = [(at(x, y), at(x + dx, y + dy), 1.0) for x in range(side) for y in range(side) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < side and 0 <= y + dy < side]
    graph = kernel.Adjacency(*map(np.array, zip(*e, strict=True)))
    goal = at(25, 15)
    ahead = lambda i: float(abs(i // side - 25) + abs(i % side - 15))
    plain_, star = graph.heap([(at(5, 15), 0.0)], {goal}), graph.heap([(at(5, 15), 0.0)], {goal}, ahead)
    assert star[goal] == plain_[goal] == 20 and len(star) * 5 < len(plain_) < side * side


def test_callable_strategy_gets_its_targets(spark, small):
    g, _, _ = small
    seen = []

    def own(edges, seeds, targets):
        seen.append(sorted((r.origin_id, r.target) for r in targets.collect()))
        return relax.relax(edges, seeds)

    r = routing.shortest_paths(g, spark.createDataFrame([(0, 3, 14), (1, 4, 9)], "query_id long, origin_id long, destination_id long"), own).collect()
    assert seen == [[(3, 14), (4, 9)]] and len(r) == 2


@pytest.mark.parametrize("strategy", ["kernel", "loop"])
@pytest.mark.parametrize("search", [relax.dijkstra_negative, relax.bellman_ford])
def test_negative(spark, strategy, search):
    edges = [(0, 1, 4.0), (0, 2, 9.0), (2, 1, -7.0), (1, 3, 1.0), (3, 4, -2.0)]
    seeds = spark.createDataFrame([(0, 0, 0.0), (9, 9, 2.0)], "origin_id long, node long, dist double")
    table = lambda e: spark.createDataFrame(e, "src long, dst long, weight double")
    got = {(r.origin_id, r.node): r.dist for r in search(table(edges), seeds, strategy=strategy).collect()}
    assert got == {(0, 0): 0, (0, 1): 2, (0, 2): 9, (0, 3): 3, (0, 4): 1, (9, 9): 2}
    with pytest.raises(relax.NegativeCycle):
        search(table([*edges, (4, 2, -2.0), (1, 2, 5.0)]), seeds, strategy=strategy)
    far = search(table([*edges, (7, 8, -5.0), (8, 7, 1.0)]), seeds, strategy=strategy)  # out of reach
    assert far.count() == 6
    assert search(table([*edges, (4, 0, 0.0), (3, 0, -3.0)]), seeds, strategy=strategy).count() == 6  # a cycle of nought


def test_long_negative_cycle(spark):
    n = 20_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.when(F.col("id") == 7, -1.0 * n).otherwise(1.0).alias("weight"))
    with pytest.raises(relax.NegativeCycle):
        relax.dijkstra_negative(ring, relax.seeds_of(spark.range(1), "id"))


@pytest.mark.parametrize("most", [nearest.NEAR_NODES, 0])
def test_nearest(spark, most):
    """A city, all in one degree, points at and about the poles, and the date line, by the tree and by cells."""
    rnd = random.Random(7)
    nodes = [(i, 48 + rnd.random() * 0.1, 11 + rnd.random() * 0.1) for i in range(400)] + [(1000, 89.99, 10.0), (1001, -90.0, 0.0), (1002, 0.0, 179.99), (1003, 48.05, 11.05), (1004, 48.05, 11.05), (1005, 10.0, -60.0)]
    points = [(i, 48 + rnd.random() * 0.1, 11 + rnd.random() * 0.1) for i in range(100)] + [(200, 90.0, -100.0), (201, -89.9, 120.0), (202, 0.0, -179.99), (203, 48.05, 11.05), (204, -20.0, -70.0), (205, 90.0, 3.0)]
    got = {r.point_id: r.node_id for r in nearest.nearest(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, lat double, lon double"), most).collect()}
    assert set(got) == {p[0] for p in points} and got[203] == 1003
    for i, lat, lon in points:
        best = min(km((lat, lon), n[1:]) for n in nodes)
        at = next(n for n in nodes if n[0] == got[i])
        assert km((lat, lon), at[1:]) == pytest.approx(best, abs=1e-6)
    assert nearest.nearest(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(nodes[:0], "node_id long, lat double, lon double"), most).count() == 0


def test_box_in_a_city(spark):
    rnd = random.Random(3)
    nodes = [(i, rnd.random() * 0.02, rnd.random() * 0.02) for i in range(200)]
    points = [(i, rnd.random() * 0.02, rnd.random() * 0.02) for i in range(40)]
    for bound in (0.001, 0.0001, 0.02, 3.0):
        got = {(r.point_id, r.node_id) for r in attach.in_box(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, lat double, lon double"), bound).collect()}
        assert got == {(p[0], n[0]) for p in points for n in nodes if abs(p[1] - n[1]) <= bound and abs(p[2] - n[2]) <= bound}


def test_matrix_of_unreachable_and_lone_nodes(spark, net):
    g, rows, at = net
    points = spark.createDataFrame([(0, *at[3]), (1, *at[900]), (2, *at[901]), (3, 5.0, 5.0), (4, at[3][0] + 1e-6, at[3][1]), (5, *at[140])], "point_id long, lat double, lon double")
    got = {(r.i, r.j): r.distance for r in routing.distance_matrix(g, points).collect()}
    assert len(got) == 36 and got[3, 3] == 0 and got[0, 4] == 0 and got[3, 0] is None and got[2, 1] is None and got[1, 2] == pytest.approx(200)
    assert got[0, 5] == pytest.approx(plain(rows, [(3, 0.0)])[140])


def test_merge_of_single_nodes(spark):
    one = GeoGraph(spark.createDataFrame([], "src long, dst long, weight double"), spark.createDataFrame([(0, 1.0, 1.0)], "node_id long, lat double, lon double"))
    port = spark.createDataFrame([(0, 1.0, 1.5)], "point_id long, lat double, lon double")
    got = attach.merge(one, one, port)
    assert sorted(r.node_id for r in got.nodes.collect()) == [0, 1, 2]
    assert {(r.src, r.dst) for r in got.edges.collect()} == {(2, 0), (0, 2), (2, 1), (1, 2)}


def test_merge_keeps_shapes(spark):
    shape = "src long, dst long, weight double, shape array<struct<lat:double,lon:double>>"
    nodes = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 2.0)], "node_id long, lat double, lon double")
    a = GeoGraph(spark.createDataFrame([(0, 1, 9.0, [(1.5, 1.4)])], shape), nodes)
    b = GeoGraph(spark.createDataFrame([(1, 0, 9.0)], "src long, dst long, weight double"), nodes)
    got = {(r.src, r.dst): r["shape"] for r in attach.merge(a, b, spark.createDataFrame([(0, 1.0, 1.5)], "point_id long, lat double, lon double")).edges.collect()}
    assert [tuple(p) for p in got[0, 1]] == [(1.5, 1.4)] and got[3, 2] is None and got[4, 0] is None


def test_osm_shape_is_the_lightest_edges(spark):
    nodes = spark.createDataFrame([(10, 1.0, 2.0), (11, 3.0, 4.0)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(10, 11, 1500.4, [(2.0, 3.0)]), (10, 11, 900.25, [(2.5, 3.5)]), (10, 11, 4000.0, [(9.0, 9.0)])], "u long, v long, length double, geometry array<struct<x:double,y:double>>")
    (e,) = files.from_osm(nodes, edges).edges.collect()
    assert e.weight == 0.9 and [tuple(p) for p in e["shape"]] == [(3.5, 2.5)]


def test_index_ids(spark, small):
    ch = hierarchy.build(small[0], core=31)
    tn = transit.build(ch, 6)
    bad = spark.createDataFrame([(0, 1, 4444)], "query_id long, origin_id long, destination_id long")
    for check in (lambda: hierarchy.search(ch, bad), lambda: transit.distances(tn, bad), lambda: transit.search(tn, bad)):
        with pytest.raises(ValueError):
            check()
    good = spark.createDataFrame([(0, 1, 22), (1, 5, 900), (2, 7, 7)], "query_id long, origin_id long, destination_id long")
    want = {0: pytest.approx(plain(small[1], [(1, 0.0)])[22]), 1: None, 2: 0}
    assert {r.query_id: r.length for r in transit.distances(tn, good).collect()} == want


def test_cache_of_another_graph(spark, net):
    g, _, _ = net
    from meshroute.operators.cache import TreeCache

    c = TreeCache(g)
    q = spark.createDataFrame([(0, *net[2][3], *net[2][140])], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double")
    before = routing.route(g, q, strategy="cached_shortest_path", index=c, length_only=True).first().length
    half = g.with_(edges=g.edges.withColumn("weight", F.col("weight") / 2))
    assert routing.route(half, q, strategy="cached_shortest_path", index=c, length_only=True).first().length == pytest.approx(before / 2)
    twin = model.Graph(half.edges, half.nodes, g.version)  # of the same version, but not the graph
    assert c.of(g) is c and c.of(twin) is not c
