import json
import random
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from meshroute.operators import cache, hierarchy, model, paths, relax, transit

SIX = [{1: 5, 2: 1}, {0: 5, 2: 2, 3: 1}, {0: 1, 1: 2, 3: 4, 4: 8}, {1: 1, 2: 4, 4: 3, 5: 6}, {2: 8, 3: 3}, {3: 6}]
LOOSE = [*SIX, {7: 1}, {8: 1}, {6: 1}]


@pytest.fixture(scope="module")
def six(spark):
    return model.from_adjacency(spark, SIX)


def pairs(spark, *od):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(od)], "query_id long, origin_id long, destination_id long")


def origins(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "origin_id long")


def heap(adjacency, start):
    dist, queue = {}, [(0, start)]
    while queue:
        d, x = heappop(queue)
        if x not in dist:
            dist[x] = d
            for y, w in adjacency[x].items():
                heappush(queue, (d + w, y))
    return dist


@pytest.mark.parametrize("name", [*relax.STRATEGIES, "kernel"])
def test_strategies(spark, six, name):
    seeds = relax.seeds_of(origins(spark, 0))
    targets = spark.createDataFrame([(0, 5)], "origin_id long, target long")
    if name == "kernel":
        got = relax.kernel_trees(six.edges, seeds)
    else:
        got = relax.strategy_named(name)(six.edges, seeds, targets if name in ("a_star", "dijkstra") else None)
    found = {r.node: r.dist for r in got.collect()}
    assert found[5] == 10
    if name not in ("a_star", "dijkstra"):
        assert found == {0: 0, 1: 3, 2: 1, 3: 4, 4: 7, 5: 10}


def test_unknown_strategy():
    with pytest.raises(ValueError):
        relax.strategy_named("best")


def test_paths(spark, six):
    q = pairs(spark, (0, 5), (5, 0), (4, 0), (2, 2))
    got = {r.query_id: (r.length, r.path) for r in cache.TreeCache(six).shortest_paths(q).collect()}
    want = {0: (10, [0, 2, 1, 3, 5]), 1: (10, [5, 3, 1, 2, 0]), 2: (7, [4, 3, 1, 2, 0]), 3: (0, [2])}
    assert got == want
    w = paths.path_weights(six.edges, spark.createDataFrame([(i, p) for i, (_, p) in want.items()] + [(9, [0, 5])], "query_id long, path array<long>"))
    assert {r.query_id: (r.weight, r.missing) for r in w.collect()} == {**{i: (n, 0) for i, (n, _) in want.items()}, 9: (None, 1)}


def test_unknown_ids(spark, six):
    for pair in ((0, 99), (-1, 0)):
        with pytest.raises(ValueError, match="not nodes"):
            cache.TreeCache(six).shortest_paths(pairs(spark, pair))


def test_unreachable_and_multi_source(spark):
    g = model.from_adjacency(spark, LOOSE)
    got = cache.TreeCache(g).shortest_paths(pairs(spark, (0, 7), (6, 8))).collect()
    assert {r.query_id: (r.length, r.path) for r in got} == {0: (None, None), 1: (2, [6, 7, 8])}
    seeds = spark.createDataFrame([(0, 4, 0.0), (0, 0, 0.0)], "origin_id long, node long, dist double")
    for strategy in ("loop", "kernel"):
        assert {r.node: r.dist for r in relax.trees(g.edges, seeds, strategy).collect()} == {0: 0, 1: 3, 2: 1, 3: 3, 4: 0, 5: 9}


def test_cache(spark, six):
    c = cache.TreeCache(six)
    c.ensure(origins(spark, 0, 1))
    again = cache.TreeCache(six)
    again.set(c.get())
    assert {r.query_id: r.length for r in again.shortest_paths(pairs(spark, (0, 5), (1, 5), (2, 5)), length_only=True).collect()} == {0: 10, 1: 7, 2: 9}
    with pytest.raises(ValueError):
        again.set(c.get().withColumn("node", F.col("node") + 100))
    c.graph = model.add_edge(six, 0, 5, 1.0)
    assert c.shortest_paths(pairs(spark, (0, 5))).first().length == 1


def test_negative(spark):
    ok = model.from_adjacency(spark, [{1: -1}, {2: 2}, {0: 2}])
    bad = model.from_adjacency(spark, [{1: -5}, {2: 2}, {0: 2}])
    seeds = relax.seeds_of(origins(spark, 0))
    for f in (relax.dijkstra_negative, relax.bellman_ford):
        assert {r.node: r.dist for r in f(ok.edges, seeds).collect()} == {0: 0, 1: -1, 2: 1}
        with pytest.raises(relax.NegativeCycle):
            f(bad.edges, seeds)
    dist = relax.bellman_ford(ok.edges, seeds)
    tree = relax.predecessors_any_sign(ok.edges, dist, spark.createDataFrame([(0, 0)], "origin_id long, node long"))
    assert {r.node: r.pred for r in tree.collect()} == {0: None, 1: 0, 2: 1}


@pytest.mark.parametrize("symmetric,connected,graph", [(True, True, SIX), (False, True, [SIX[0], {**SIX[1], 0: 99}, *SIX[2:]]), (True, False, [*SIX, {7: 3}, {6: 3}]), (False, False, LOOSE), (None, False, [{1: 5}, {2: 2}, {3: 4}, {}])])
def test_validate(spark, symmetric, connected, graph):
    got = {r.rule: r.violations for r in model.validate(model.from_adjacency(spark, graph)).collect()}
    assert (got["unreached_nodes"] == 0) == connected
    assert symmetric is None or (got["asymmetric_edges"] == 0) == symmetric
    assert got["negative_or_missing_weights"] == got["dangling_edges"] == got["no_nodes"] == 0


def test_validate_bad(spark, six):
    with pytest.raises(ValueError, match="no_nodes"):
        model.assert_valid(model.from_adjacency(spark, []).with_(edges=six.edges.limit(0)))
    with pytest.raises(ValueError, match="negative"):
        model.assert_valid(model.from_adjacency(spark, [{1: -1}, {0: -1}]))
    with pytest.raises(ValueError, match="dangling"):
        model.assert_valid(model.from_adjacency(spark, [{1: 1, 9: 1}, {0: 1}]), check_symmetry=False, check_connected=False)
    model.assert_valid(six)


def test_changes(spark, six):
    out = spark.createDataFrame([(5, 2.0)], "dst long, weight double")
    g, new = model.add_node(six, out, symmetric=True)
    assert new == 6 and g.edges.count() == six.edges.count() + 2 and g.version > six.version
    back, gone = model.remove_last_node(g)
    assert [(r.dst, r.weight) for r in gone.collect()] == [(5, 2.0)]
    assert back.edges.exceptAll(six.edges).count() == 0 and back.size() == 6
    g, w = model.remove_edge(six, 0, 2, symmetric=True)
    assert w == 1 and g.edges.count() == six.edges.count() - 2
    assert model.remove_edge(six, 0, 5)[1] is None
    assert {(r.dst, r.weight) for r in model.add_edge(six, 0, 1, 2).neighbours(0).collect()} == {(1, 2.0), (2, 1.0)}
    assert six.inverse().edges.exceptAll(six.edges).count() == 0
    assert {r.src: len(r.out) for r in six.packed().collect()} == {0: 2, 1: 3, 2: 4, 3: 4, 4: 2, 5: 1}
    assert model.from_pairs(model.to_pairs(six.edges)).exceptAll(six.edges).count() == 0


def test_random_against_heap(spark):
    rnd = random.Random(4)
    adjacency = [{rnd.randrange(30): rnd.randint(1, 9) for _ in range(2)} for _ in range(30)]
    g = model.from_adjacency(spark, adjacency)
    want = {(o, n): d for o in (0, 7, 9) for n, d in heap(adjacency, o).items()}
    seeds = relax.seeds_of(origins(spark, 0, 7, 9))
    assert {(r.origin_id, r.node): r.dist for r in relax.relax(g.edges, seeds).collect()} == want
    dist = relax.kernel_trees(g.edges, seeds)
    assert {(r.origin_id, r.node): r.dist for r in dist.collect()} == want
    q = pairs(spark, *[(o, n) for o in (0, 7, 9) for n in range(0, 30, 5)])
    index = hierarchy.build(g)
    lengths = {r.query_id: (r.length, r.path) for r in hierarchy.search(index, q).collect()}
    t = {r.query_id: r.length for r in transit.distances(transit.build(index, 8), q).collect()}
    for i, o, n in [(r.query_id, r.origin_id, r.destination_id) for r in q.collect()]:
        assert lengths[i][0] == want.get((o, n)) == t[i]
        if p := lengths[i][1]:
            assert p[0] == o and p[-1] == n and sum(adjacency[a][b] for a, b in zip(p, p[1:])) == lengths[i][0]


def test_indexes(spark, six, tmp_path):
    q = pairs(spark, (0, 5), (5, 0), (4, 0), (2, 2))
    index = hierarchy.build(six)
    index.save(f"{tmp_path}/ch")
    for i in (index, hierarchy.load(spark, f"{tmp_path}/ch", with_original=False)):
        assert {r.query_id: (r.length, r.path) for r in hierarchy.search(i, q).collect()} == {0: (10, [0, 2, 1, 3, 5]), 1: (10, [5, 3, 1, 2, 0]), 2: (7, [4, 3, 1, 2, 0]), 3: (0, [2])}
    t = transit.build(index, 2)
    t.save(f"{tmp_path}/tnr")
    for x in (t, transit.load(spark, f"{tmp_path}/tnr")):
        assert {r.query_id: r.length for r in transit.distances(x, q).collect()} == {0: 10, 1: 10, 2: 7, 3: 0}
        assert transit.search(x, q.where("query_id = 0")).first().path == [0, 2, 1, 3, 5]
    grown = hierarchy.add_node(index, 6, spark.createDataFrame([(0, 1.0)], "dst long, weight double"))
    assert hierarchy.search(grown, pairs(spark, (6, 5), (5, 6))).first().length == 11
