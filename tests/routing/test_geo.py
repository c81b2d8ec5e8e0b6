import json
import math
import random

import pytest
from pyspark.sql import functions as F

from meshroute.functions import geodesy
from meshroute.operators import attach, grid, model, routing, simplify
from meshroute.operators.model import GeoGraph
from meshroute.sources import files

SIX = [{1: 5, 2: 1}, {0: 5, 2: 2, 3: 1}, {0: 1, 1: 2, 3: 4, 4: 8}, {1: 1, 2: 4, 4: 3, 5: 6}, {2: 8, 3: 3}, {3: 6}]
AT = [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1)]


@pytest.fixture(scope="module")
def six(spark):
    g = model.from_adjacency(spark, SIX)
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(AT)], "node_id long, lat double, lon double")
    return GeoGraph(g.edges, nodes)


def trips(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "query_id long, o_lat double, o_lon double, d_lat double, d_lon double")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(geodesy.haversine(52.4862, -1.8904, 41.6488, -0.8891)) == pytest.approx(km((52.4862, -1.8904), (41.6488, -0.8891)))
    assert v(geodesy.haversine(0, 179, 0, -179)) == pytest.approx(km((0, 0), (0, 2)))
    assert v(geodesy.haversine(0, 0, 0, 1, "mi", 2)) == pytest.approx(2 * math.pi * 3959 / 180)
    assert v(geodesy.cheap_ruler(50, 179.9, 50, -179.9)) == pytest.approx(v(geodesy.haversine(50, 179.9, 50, -179.9)), rel=0.01)
    assert [v(geodesy.hard_round(1, x)) for x in (0.25, -0.25, 0.0, 1.04)] == [0.3, -0.3, 0.0, 1.0]
    assert v(geodesy.convert(F.lit(2.0), "m", "km")) == pytest.approx(0.002)
    with pytest.raises(ValueError):
        geodesy.convert(F.lit(1.0), "km", "yd")
    assert [v(geodesy.wrap(180, x)) for x in (181.0, -181.0, 180.0, 5.5)] == [1.0, -1.0, 0.0, 5.5]
    assert v(geodesy.triangle_area(0, 0, 2, 0, 0, 2)) == 4 and v(geodesy.area_plus_edge(0, 0, 2, 0, 0, 2)) == 8
    assert v(geodesy.euclidean(0, 0, 3, 4)) == 5
    pts = F.array(F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")))
    assert v(geodesy.coordinates(pts)) == [[1, 2]] and v(geodesy.coordinates(pts, "list_of_lists_long_first")) == [[2, 1]]
    assert v(geodesy.coordinates(pts, "list_of_dicts"))[0].asDict() == {"latitude": 1, "longitude": 2}
    with pytest.raises(ValueError):
        geodesy.coordinates(pts, "circle")


def test_nearest_against_all(spark):
    rnd = random.Random(2)
    nodes = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(80)] + [(80, 89.9, 0.0), (81, 0.0, 179.9)]
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)] + [(60, 89.9, 170.0), (61, 0.0, -179.9), (62, -90.0, 3.0)]
    got = attach.nearest_node(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(nodes, "node_id long, lat double, lon double")).collect()
    assert len(got) == len(points)
    for r in got:
        p = points[r.point_id][1:]
        best = min(km(p, n[1:]) for n in nodes)
        assert r.leg == pytest.approx(best) == pytest.approx(km(p, nodes[r.node_id][1:]))


def test_attach(spark, six):
    p = spark.createDataFrame([(0, 0.9, 0.9), (1, 40.0, 40.0)], "point_id long, lat double, lon double")
    by = lambda m, **k: {(r.point_id, r.node_id) for r in attach.attach(p, six.nodes, m, bound=1.5, **k).collect()}
    assert by("closest") == by("kdclosest") == {(0, 3), (1, 5)}
    assert by("quadrant") == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 5)}
    assert by("all", math_="haversine") == {(0, n) for n in range(6)} | {(1, 5)}
    with pytest.raises(ValueError):
        by("farthest")
    g, new = attach.attach_node(six, 0.5, 0.5, "quadrant", circuity=2)
    assert new == 6 and g.edges.where("src = 6").count() == 4 == g.edges.where("dst = 6").count()
    w = {r.dst: r.weight for r in g.neighbours(6).collect()}
    assert w[0] == pytest.approx(2 * km((0.5, 0.5), (0, 0)), abs=1e-4)
    assert model.remove_last_node(g)[0].edges.exceptAll(six.edges).count() == 0
    h = attach.add_haversine_edge(six, 0, 5)
    assert h.edges.where("src = 5 and dst = 0").first().weight == pytest.approx(km(AT[0], AT[5]))
    with pytest.raises(ValueError):
        attach.attach_node(six, 95, 0)


def test_route(spark, six):
    r = routing.route(six, trips(spark, (0, 0, 2, 1), (0.1, 0.1, 0.05, 0.2), (0, 0, 0, 0))).orderBy("query_id").collect()
    assert r[0].length == 10 and r[0].path == [0, 2, 1, 3, 5]
    assert r[0].coordinate_path == [[0, 0], [0, 0], [1, 0], [0, 1], [1, 1], [2, 1], [2, 1]]
    assert r[1].length == pytest.approx(km((0.1, 0.1), (0.05, 0.2))) and r[1].path == [] and len(r[1].coordinate_path) == 2
    assert r[2].length == 0
    miles = routing.route(six, trips(spark, (0, 0, 2, 1)), output_units="mi", length_only=True).first().length
    assert miles == pytest.approx(6.21371)
    with pytest.raises(ValueError):
        routing.route(six, trips(spark, (0, 0, 91, 0)))
    with pytest.raises(ValueError):
        routing.route(six, trips(spark, (0, 0, 1, 0)), strategy="tnr", origin_method="all")


@pytest.mark.parametrize("strategy", ["dijkstra_buckets", "bmssp", "bellman_ford"])
def test_route_strategies(spark, six, strategy):
    assert routing.route(six, trips(spark, (0, 0, 2, 1)), strategy=strategy, length_only=True).first().length == 10


@pytest.mark.parametrize("strategy", routing.INDEXED)
def test_route_by_index(spark, six, strategy):
    q = trips(spark, (0, 0, 2, 1), (0.1, 0.1, 0.05, 0.2), (1, 2, 0, 0))
    key = lambda r: (r.query_id, round(r.length, 6), r.path, r.coordinate_path)
    assert sorted(map(key, routing.route(six, q, strategy=strategy).collect())) == sorted(map(key, routing.route(six, q).collect()))


def test_route_with_added_ends(spark, six):
    heavy = six.with_(edges=six.edges.withColumn("weight", F.col("weight") * 40))
    r = routing.route(heavy, trips(spark, (-0.2, 0.1, 2.2, 1.1)), origin_method="closest", destination_method="closest").first()
    legs = km((-0.2, 0.1), (0, 0)) + km((2, 1), (2.2, 1.1))
    straight = km((-0.2, 0.1), (2.2, 1.1))
    assert r.length in (pytest.approx(400 + legs), pytest.approx(straight))


def test_matrix(spark, six):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0), (2, 0.1, 0.0)], "point_id long, lat double, lon double")
    m = {(r.i, r.j): r.distance for r in routing.distance_matrix(six, p).collect()}
    assert m[0, 1] == m[1, 0] == 10 and m[0, 2] == 0 == m[0, 0]
    assert m[2, 1] == pytest.approx(10 + km((0.1, 0), (0, 0)))
    island = GeoGraph(six.edges.where("src < 5 and dst < 5"), six.nodes)
    lone = {(r.i, r.j): r.distance for r in routing.distance_matrix(island, p).collect()}
    assert lone[0, 1] is None and lone[1, 1] == 0
    assert [r.row for r in routing.dense_matrix(routing.distance_matrix(six, p)).orderBy("i").collect()][0][:2] == [0, 10]


def test_cross_network(spark, six):
    q = trips(spark, (0, 0, 2, 1), (0, 0, 2, 1), (0.1, 0, 2, 1)).withColumn("path", F.when(F.col("query_id") == 0, F.array(*[F.lit(x).cast("long") for x in (0, 2, 1, 3, 5)])).when(F.col("query_id") == 1, F.array().cast("array<bigint>")).otherwise(F.array(*[F.lit(x).cast("long") for x in (0, 5)])))
    got = {r.query_id: r.weight for r in routing.cross_network_weights(six, q).collect()}
    assert got[0] == 10 and got[1] == pytest.approx(km((0, 0), (2, 1))) and got[2] is None


def test_merge(spark, six):
    ports = spark.createDataFrame([(0, 1.5, 1.5)], "point_id long, lat double, lon double")
    g = attach.merge(six, six, ports)
    assert g.nodes.count() == 13 and g.edges.count() == 2 * six.edges.count() + 4
    assert {r.dst for r in g.neighbours(12).collect()} <= set(range(12))


def wall(n, x):
    return [(x, y) for y in range(3, n)]


def test_grid(spark, tmp_path):
    g = grid.build(spark, 11, 10, wall(10, 5))
    q = spark.createDataFrame([(0, 1.0, 8.0, 8.0, 8.0), (1, 1.0, 1.1, 1.0, 2.3), (2, 0.0, 0.0, 8.0, 8.0)], "query_id long, ox double, oy double, dx double, dy double")
    r = grid.route(g, q, form="list_of_lists").orderBy("query_id").collect()
    assert r[0].length == pytest.approx(16.071, abs=5e-4)
    assert r[1].length == pytest.approx(1.4) and r[1].coordinate_path == [[1, 1.1], [1, 1], [1, 2], [1, 2.3]] and r[1].path == [-1, 12, 23, -1]
    assert r[2].length is None
    assert g.place(g.index(3, 4)) == (3, 4)
    grid.save(g, f"{tmp_path}/g")
    again = grid.load(spark, f"{tmp_path}/g")
    assert (again.x_size, again.y_size) == (11, 10) and again.blocks.count() == g.blocks.count()
    assert grid.route(again, q.where("query_id = 0")).first().length == r[0].length
    with pytest.raises(ValueError):
        g.index(11, 0)
    big = grid.build(spark, 20, 20, [(10, y) for y in range(5, 20)], walls=True)
    assert grid.route(big, spark.createDataFrame([(0, 2.0, 10.0, 18.0, 10.0)], "query_id long, ox double, oy double, dx double, dy double")).first().length == pytest.approx(20.9704)


def test_simplify(spark):
    assert simplify.simplify_line([(1, 1), (2, 2), (3, 2), (4, 1), (5, 1)], 50, 3) == [(1, 1), (3, 2), (4, 1), (5, 1)]
    assert simplify.simplify_line([(0, 0), (1, 1)], 0) == [(0, 0), (1, 1)]
    rows = [(1, i, float(i), float(i % 3)) for i in range(9)] + [(2, 0, 0.0, 0.0), (2, 1, 0.0, 0.0)]
    lines = simplify.clean_lines(spark.createDataFrame(rows, "line_id long, seq int, x double, y double"))
    assert lines.select("line_id").distinct().count() == 1
    out = simplify.simplify_lines(lines, 0, 2, "area_plus_edge").orderBy("seq").collect()
    assert [(r.seq, r.x) for r in out] == [(0, 0), (1, 8)]


def test_files(spark, six, tmp_path):
    shaped = GeoGraph(six.edges.withColumn("shape", F.when(F.col("src") == 0, F.array(F.struct(F.lit(0.5).alias("lat"), F.lit(0.25).alias("lon"))))), six.nodes, units="mi")
    files.write_graphjson(shaped, f"{tmp_path}/a.graphjson")
    back = files.read_graphjson(spark, f"{tmp_path}/a.graphjson")
    assert back.units == "mi" and back.nodes.exceptAll(six.nodes).count() == 0
    assert back.edges.where("src = 0").first().shape[0].asDict() == {"lat": 0.5, "lon": 0.25}
    assert back.edges.select("src", "dst", "weight").exceptAll(six.edges.select("src", "dst", "weight")).count() == 0
    with pytest.raises(ValueError):
        files.read_graphjson(spark, f"{tmp_path}/a.json")
    files.save(shaped, f"{tmp_path}/p")
    assert files.load(spark, f"{tmp_path}/p").units == "mi"
    files.write_geojson(shaped, f"{tmp_path}/b.geojson")
    doc = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/b.geojson").collect()))
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == six.edges.count()
    assert doc["features"][0]["geometry"]["coordinates"] == [[0, 0], [0.25, 0.5], [1, 0]]
    files.write_geojson(six, f"{tmp_path}/c.geojson", compact=True)
    g = files.read_geojson(spark, f"{tmp_path}/c.geojson", min_points=2)
    assert g.nodes.count() == 6 and g.edges.count() == six.edges.count()
    assert g.edges.where("weight > 0").count() == g.edges.count()
    files.write_geojson(GeoGraph(six.edges.limit(0), six.nodes), f"{tmp_path}/d.geojson")
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/d.geojson").collect()))["features"] == []
    files.write_geojson_lines(shaped, f"{tmp_path}/e")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/e").collect()]
    by_ends = lambda f: (f["properties"]["origin_idx"], f["properties"]["destination_idx"])
    assert sorted(lines, key=by_ends) == doc["features"]
    files.write_simplified_geojson(spark, f"{tmp_path}/b.geojson", f"{tmp_path}/f.geojson", pct_to_keep=0, min_points=2)
    thin = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/f.geojson").collect()))
    ends = lambda d: sorted([f["geometry"]["coordinates"][0], f["geometry"]["coordinates"][-1]] for f in d["features"])
    assert ends(thin) == ends(doc) and all(len(f["geometry"]["coordinates"]) == 2 for f in thin["features"])
    reg = files.Registry(spark, f"{tmp_path}/reg")
    reg.put("six", shaped)
    assert [(r.name, r.cached) for r in reg.list(["far"]).collect()] == [("far", False), ("six", True)]
    assert reg.get("six").edges.count() == six.edges.count()
    with pytest.raises(FileNotFoundError):
        reg.get("far")
    reg.clear()
    assert reg.list().count() == 0


def test_lines_with_shapes(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 2.0, 0.0), (1, 3, 3.0, 0.0), (2, 0, 2.0, 0.0), (2, 1, 2.0, 1.0)]
    v = spark.createDataFrame(rows, "line_id long, seq int, x double, y double")
    plain = files.graph_of_lines(v)
    assert plain.nodes.count() == 5 and plain.edges.count() == 8
    kept = files.graph_of_lines(v, keep_shapes=True)
    assert kept.nodes.count() == 4 and kept.edges.count() == 6
    long = kept.edges.where(F.size("shape") > 0).collect()
    assert len(long) == 2 and all(r.shape[0].lon == 1.0 and r.weight == pytest.approx(km((0, 0), (0, 2)), abs=2e-3) for r in long)


def test_osm(spark):
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (20, 1.0, 0.0)], "osmid long, x double, y double")
    edges = spark.createDataFrame([(10, 20, 1500.0, 90.0), (10, 20, 1200.4, 99.0)], "u long, v long, length double, travel_time double")
    g = files.from_osm(nodes, edges)
    assert [r.weight for r in g.edges.collect()] == [1.2]
    t = files.from_osm(nodes, edges, weight="travel_time", speed=50)
    assert t.off_graph_circuity == t.node_addition_circuity == 72 and t.edges.first().weight == 90
    assert files.from_osm(nodes, edges, weight="travel_time").node_addition_circuity == 240


def test_route_features(spark, six):
    q = trips(spark, (0, 0, 2, 1)).withColumn("properties", F.create_map(F.lit("a"), F.lit("b")))
    doc = json.loads(files.route_features(six, q).first().value)
    assert doc["properties"] == {"a": "b"} and doc["geometry"]["coordinates"][1:3] == [[0, 0], [0, 1]]
    line = json.loads(files.line_path(routing.route(six, q)).first().value)
    assert line["type"] == "LineString" and line["coordinates"][2] == [0, 1]
