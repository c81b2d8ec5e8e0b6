"""Readers and writers: JSON documents of networks, GeoJSON, OSM-like tables, Parquet folders and their registry.

Large networks live in Parquet (save, load); JSON is for exchange. Every reader and writer goes through Spark, so
that any store Spark knows will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshroute.functions import geodesy
from meshroute.operators import simplify
from meshroute.operators.model import GeoGraph, lightest, lightest_rows
from meshroute.session import cut

GRAPH_SCHEMA = """type string, graph array<map<string,double>>, nodes array<array<double>>,
    intermediate_nodes array<map<string,array<array<double>>>>, default_off_graph_circuity double,
    default_node_addition_circuity double, geograph_units string"""
GEOJSON_SCHEMA = "type string, coordinates string, features array<struct<geometry:struct<type:string,coordinates:string>>>, geometry struct<type:string,coordinates:string>, geometries array<struct<type:string,coordinates:string>>"


def _suffix(path: str, suffix: str) -> None:
    if not path.endswith(suffix):
        raise ValueError(f"{path} doesn't end with {suffix}")


# ---- Parquet


def save(graph: GeoGraph, path: str) -> None:
    """nodes, edges and a one-row table of the network's properties."""
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(graph.units, float(graph.off_graph_circuity), float(graph.node_addition_circuity))]
    graph.spark.createDataFrame(meta, "units string, off_graph_circuity double, node_addition_circuity double").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> GeoGraph:
    meta = spark.read.parquet(f"{path}/meta").first()
    return GeoGraph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), units=meta.units, off_graph_circuity=meta.off_graph_circuity, node_addition_circuity=meta.node_addition_circuity)


class Registry:
    """Named networks under one folder: a table of names and the Parquet folders of those that are there."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get("meshroute.registry", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/networks").rstrip("/")

    def _path(self, sub: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{sub}" if sub else self.root)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def list(self, known: list[str] = ()) -> DataFrame:
        """(name, cached) of the known names and those that are there, in order."""
        p, fs = self._path()
        there = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
        rows = [(n, n in there) for n in sorted(there | set(known))]
        return self.spark.createDataFrame(rows, "name string, cached boolean")

    def put(self, name: str, graph: GeoGraph) -> None:
        save(graph, f"{self.root}/{check_name(name)}")

    def get(self, name: str) -> GeoGraph:
        p, fs = self._path(name)
        if not fs.exists(p):
            raise FileNotFoundError(f"no network {name!r} under {self.root}")
        return load(self.spark, f"{self.root}/{name}")

    def clear(self) -> None:
        p, fs = self._path()
        fs.delete(p, True)


# ---- The JSON document of a network


def read_graphjson(spark: SparkSession, path: str) -> GeoGraph:
    _suffix(path, ".graphjson")
    doc = cut(spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True))
    meta = doc.select("type", "default_off_graph_circuity", "default_node_addition_circuity", "geograph_units", F.col("intermediate_nodes").isNotNull().alias("shaped")).first()
    if meta is None or meta.type != "GeoGraph":
        raise ValueError(f"{path} holds no GeoGraph")
    nodes = doc.select(F.posexplode("nodes").alias("node_id", "p")).select(F.col("node_id").cast("long").alias("node_id"), F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))
    edges = doc.select(F.posexplode("graph").alias("src", "out")).select(F.col("src").cast("long").alias("src"), F.explode("out").alias("dst", "weight")).select("src", F.col("dst").cast("long").alias("dst"), "weight")
    if meta.shaped:
        s = doc.select(F.posexplode("intermediate_nodes").alias("s_src", "out")).select("s_src", F.explode("out").alias("s_dst", "pts")).select("s_src", F.col("s_dst").cast("long").alias("s_dst"), F.transform("pts", lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon"))).alias("shape"))
        edges = edges.join(s, (F.col("src") == F.col("s_src")) & (F.col("dst") == F.col("s_dst")), "left").select("src", "dst", "weight", "shape")
    return GeoGraph(edges, nodes, units=meta.geograph_units or "km", off_graph_circuity=meta.default_off_graph_circuity or 1.0, node_addition_circuity=meta.default_node_addition_circuity or 4.0)


def graphjson(graph: GeoGraph, shapes: bool = True) -> DataFrame:
    """One row, one JSON document; node ids must be 0, 1, 2, ... For exchange of networks that fit in one row."""
    from meshroute.operators.model import to_pairs

    out = to_pairs(graph.edges.select("src", "dst", "weight")).withColumnRenamed("src", "o_src")
    shaped = shapes and "shape" in graph.edges.columns
    rows = graph.nodes.join(out, F.col("node_id") == F.col("o_src"), "left").select("node_id", F.array("lat", "lon").alias("at"), F.coalesce("out", F.expr("map()").cast("map<bigint,double>")).alias("out"))
    if shaped:
        s = graph.edges.where("shape is not null").groupBy(F.col("src").alias("s_src")).agg(F.map_from_entries(F.collect_list(F.struct("dst", F.transform("shape", lambda p: F.array(p["lat"], p["lon"]))))).alias("shape"))
        rows = rows.join(s, F.col("node_id") == F.col("s_src"), "left").withColumn("shape", F.coalesce("shape", F.expr("map()").cast("map<bigint,array<array<double>>>")))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(*[c for c in ("node_id", "at") if c]))).alias("n"), F.map_from_entries(F.collect_list(F.struct("node_id", "out"))).alias("o"), *([F.map_from_entries(F.collect_list(F.struct("node_id", "shape"))).alias("s")] if shaped else []))
    doc = [F.lit("GeoGraph").alias("type"), F.transform("n", lambda x: F.col("o")[x["node_id"]]).alias("graph"), F.transform("n", lambda x: x["at"]).alias("nodes"), F.lit(float(graph.off_graph_circuity)).alias("default_off_graph_circuity"), F.lit(float(graph.node_addition_circuity)).alias("default_node_addition_circuity"), F.lit(graph.units).alias("geograph_units")]
    if shaped:
        doc.append(F.transform("n", lambda x: F.col("s")[x["node_id"]]).alias("intermediate_nodes"))
    return whole.select(F.to_json(F.struct(*doc)).alias("value"))


def write_graphjson(graph: GeoGraph, path: str, shapes: bool = True) -> None:
    _suffix(path, ".graphjson")
    graphjson(graph, shapes).coalesce(1).write.mode("overwrite").text(path)


# ---- GeoJSON


def _lines(graph: GeoGraph, shapes: bool = True) -> DataFrame:
    """(src, dst, weight, coordinates): each edge as a line of [lon, lat]."""
    n = graph.nodes.select("node_id", "lat", "lon")
    e = graph.edges.join(n.toDF("a_id", "a_lat", "a_lon"), F.col("src") == F.col("a_id")).join(n.toDF("b_id", "b_lat", "b_lon"), F.col("dst") == F.col("b_id"))
    none = F.array().cast("array<array<double>>")
    inner = F.coalesce(F.transform("shape", lambda p: F.array(p["lon"], p["lat"])), none) if shapes and "shape" in graph.edges.columns else none
    return e.select("src", "dst", "weight", F.concat(F.array(F.array("a_lon", "a_lat")), inner, F.array(F.array("b_lon", "b_lat"))).alias("coordinates"))


def geojson_features(graph: GeoGraph, shapes: bool = True) -> DataFrame:
    """value: one GeoJSON feature for each edge."""
    line = F.struct(F.lit("LineString").alias("type"), "coordinates")
    properties = F.struct(F.col("src").alias("origin_idx"), F.col("dst").alias("destination_idx"), F.col("weight").alias("distance"))
    return _lines(graph, shapes).select("src", "dst", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), line.alias("geometry"))).alias("value"))


COLLECTION = '{"type": "FeatureCollection", "features": ['


def collection(features: DataFrame, order: list[str]) -> DataFrame:
    """One row: a FeatureCollection of features (value, and columns to order by). For exchange; it is one row."""
    all_ = features.agg(F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("f"))
    return all_.select(F.concat(F.lit(COLLECTION), F.array_join(F.transform("f", lambda x: x["value"]), ","), F.lit("]}")).alias("value"))


def compact_geojson(graph: GeoGraph, shapes: bool = True) -> DataFrame:
    """One row: all edges as one MultiLineString."""
    rows = _lines(graph, shapes).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "coordinates"))).alias("l"))
    multi = F.struct(F.lit("MultiLineString").alias("type"), F.transform("l", lambda x: x["coordinates"]).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), F.array(multi).alias("geometries"))).alias("value"))


def _write_list(elements: DataFrame, order: list[str], head: str, tail: str, path: str) -> None:
    """Writes head, the elements (value) by order with commas between, and tail: one file, an element to a line.

    The one task that writes sorts with spill and holds no more than a line, so that only the file must be of a size
    that its readers can use.
    """
    spark = elements.sparkSession
    n = F.row_number().over(Window.orderBy(*order, "value"))
    body = elements.select(F.lit(1).alias("part"), n.alias("n"), F.concat(F.when(n > 1, ",").otherwise(""), "value").alias("value"))
    ends = spark.createDataFrame([(0, 0, head), (2, 0, tail)], "part int, n int, value string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)


def write_geojson(graph: GeoGraph, path: str, compact: bool = False, shapes: bool = True) -> None:
    """One GeoJSON document: a FeatureCollection, or if compact all edges as one MultiLineString. A network without edges
    gives an empty list."""
    if compact:
        lines = _lines(graph, shapes).select("src", "dst", F.to_json("coordinates").alias("value"))
        _write_list(lines, ["src", "dst"], '{"type": "GeometryCollection", "geometries": [{"type": "MultiLineString", "coordinates": [', "]}]}", path)
    else:
        _write_list(geojson_features(graph, shapes), ["src", "dst"], COLLECTION, "]}", path)


def write_geojson_lines(graph: GeoGraph, path: str, shapes: bool = True) -> None:
    """A folder of files with one feature to a line, written by all executors; in order of src over the files."""
    geojson_features(graph, shapes).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("value").write.mode("overwrite").text(path)


def write_simplified_geojson(spark: SparkSession, path: str, target: str, precision: int = 4, pct_to_keep: float = 100, min_points: int = 3) -> None:
    """The lines of the GeoJSON documents under path as simplify_geojson() leaves them, as a FeatureCollection."""
    points = simplify_geojson(spark, path, precision, pct_to_keep, min_points)
    lines = points.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda v: F.array(v["x"], v["y"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.expr("map()").cast("map<string,string>").alias("properties"), line.alias("geometry"))
    _write_list(lines.select("line_id", F.to_json(feature).alias("value")), ["line_id"], COLLECTION, "]}", target)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, seq, lon, lat) of all LineStrings and MultiLineStrings of GeoJSON documents; others are skipped."""
    doc = spark.read.schema(GEOJSON_SCHEMA).json(path, multiLine=True)
    one = "struct<type:string,coordinates:string>"
    parts = F.concat(
        F.coalesce(F.transform("features", lambda f: f["geometry"]), F.array().cast(f"array<{one}>")),
        F.coalesce(F.col("geometries"), F.array().cast(f"array<{one}>")),
        F.array(F.coalesce(F.col("geometry"), F.struct("type", "coordinates").cast(one))),
    )
    g = doc.select(F.input_file_name().alias("file"), F.posexplode(parts).alias("g_at", "g")).where("g.type in ('LineString', 'MultiLineString')")
    multi = F.when(F.col("g.type") == "LineString", F.array(F.from_json("g.coordinates", "array<array<double>>"))).otherwise(F.from_json("g.coordinates", "array<array<array<double>>>"))
    lines = g.select("file", "g_at", F.posexplode(multi).alias("m_at", "line"))
    lines = lines.select(F.xxhash64("file", "g_at", "m_at").alias("line_id"), "file", "g_at", "m_at", F.posexplode("line").alias("seq", "p"))
    return lines.select("line_id", "file", "g_at", "m_at", "seq", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def simplify_geojson(spark: SparkSession, path: str, precision: int = 4, pct_to_keep: float = 100, min_points: int = 3) -> DataFrame:
    """(line_id, seq, x = lon, y = lat): rounded, without repeated vertices and single points, and simplified."""
    v = read_lines(spark, path)
    v = v.select("line_id", "seq", F.round("lon", precision).alias("x"), F.round("lat", precision).alias("y"))
    clean = simplify.clean_lines(v)
    return clean if pct_to_keep >= 100 else simplify.simplify_lines(clean, pct_to_keep, min_points)


def lines_geojson(vertices: DataFrame) -> DataFrame:
    """One row: lines (line_id, seq, x, y) as one MultiLineString."""
    lines = vertices.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("line_id", F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("c"))
    multi = F.struct(F.lit("MultiLineString").alias("type"), F.transform("l", lambda x: x["c"]).alias("coordinates"))
    return lines.agg(F.sort_array(F.collect_list(F.struct("line_id", "c"))).alias("l")).select(F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), F.array(multi).alias("geometries"))).alias("value"))


def graph_of_lines(vertices: DataFrame, precision: int = 5, keep_shapes: bool = False) -> GeoGraph:
    """A network of lines (line_id, seq, x = lon, y = lat).

    Nodes are the vertices, equal ones once; edges are the segments, both ways, weighing their great-circle length in
    km to three places; segments without length are dropped. With keep_shapes only the ends of lines and vertices of
    several lines are nodes; the vertices between are the shape of one edge with the summed length. Ids follow the
    order of latitude, then longitude, as tables have no order of appearance.
    """
    v = vertices.select("line_id", "seq", F.round("y", precision).alias("lat"), F.round("x", precision).alias("lon"))
    order = Window.partitionBy("line_id").orderBy("seq")
    step = v.select("line_id", "seq", "lat", "lon", F.lead("lat").over(order).alias("b_lat"), F.lead("lon").over(order).alias("b_lon")).where("b_lat is not null and (lat <> b_lat or lon <> b_lon)")
    if not keep_shapes:
        parts = step.select(F.struct("lat", "lon").alias("a"), F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).alias("b"), F.round(geodesy.haversine("lat", "lon", "b_lat", "b_lon"), 3).alias("weight"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("shape"))
    else:
        last = Window.partitionBy("line_id")
        ends = v.withColumn("z", F.max("seq").over(last)).withColumn("o", F.min("seq").over(last))
        uses = ends.groupBy("lat", "lon").agg((F.countDistinct("line_id").alias("lines")), F.max((F.col("seq") == F.col("z")) | (F.col("seq") == F.col("o"))).alias("tip")).where("lines > 1 or tip").select(F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon"))
        marked = v.join(uses, (F.col("lat") == F.col("k_lat")) & (F.col("lon") == F.col("k_lon")), "left").withColumn("key", F.col("k_lat").isNotNull())
        marked = marked.withColumn("leg", F.coalesce(geodesy.haversine(F.lag("lat").over(order), F.lag("lon").over(order), "lat", "lon"), F.lit(0.0))).withColumn("run", F.sum(F.col("key").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = marked.groupBy("line_id", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon", "leg"))).alias("p"))
        after = Window.partitionBy("line_id").orderBy("run")
        runs = runs.withColumn("next", F.lead(F.get("p", F.lit(0))).over(after)).where("next is not null")
        inner = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.struct(x["lat"], x["lon"]))
        long = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x["leg"]) + F.col("next.leg")
        parts = runs.select(F.struct(F.get("p", F.lit(0))["lat"].alias("lat"), F.get("p", F.lit(0))["lon"].alias("lon")).alias("a"), F.struct("next.lat", "next.lon").alias("b"), F.round(long, 3).alias("weight"), inner.alias("shape")).where("a <> b")
    parts = cut(parts)
    both = parts.unionByName(parts.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", F.reverse("shape").alias("shape")))
    points = both.select("a.lat", "a.lon").distinct()
    nodes = cut(_numbered(points))
    n = nodes.select("node_id", F.struct("lat", "lon").alias("at"))
    e = both.join(n.toDF("src", "s_at"), F.col("a") == F.col("s_at")).join(n.toDF("dst", "d_at"), F.col("b") == F.col("d_at"))
    best = e.groupBy("src", "dst").agg(F.min_by(F.struct("weight", "shape"), "weight").alias("e")).select("src", "dst", "e.weight", "e.shape")
    return GeoGraph(best if keep_shapes else best.drop("shape"), nodes)


def _numbered(points: DataFrame) -> DataFrame:
    """(node_id, lat, lon) with ids 0, 1, 2, ... by latitude and longitude: ranks within whole degrees of latitude, after
    the counts of the degrees below (181 rows at most)."""
    p = points.withColumn("band", F.floor("lat").cast("int"))
    sizes = p.groupBy("band").count().withColumn("k", F.lit(0)).withColumn("before", F.sum("count").over(Window.partitionBy("k").orderBy("band")) - F.col("count")).select(F.col("band").alias("b_band"), "before")
    ranked = p.withColumn("at", F.row_number().over(Window.partitionBy("band").orderBy("lat", "lon")))
    return ranked.join(sizes, F.col("band") == F.col("b_band")).select((F.col("before") + F.col("at") - 1).cast("long").alias("node_id"), "lat", "lon")


def read_geojson(spark: SparkSession, path: str, precision: int = 5, pct_to_keep: float = 100, min_points: int = 3, keep_shapes: bool = False) -> GeoGraph:
    return graph_of_lines(simplify_geojson(spark, path, precision, pct_to_keep, min_points), precision, keep_shapes)


# ---- Tables in the form of OpenStreetMap extracts


def from_osm(nodes: DataFrame, edges: DataFrame, weight: str = "length", coordinate_places: int = 5, weight_places: int = 3, speed: float | None = None, shapes: bool = True) -> GeoGraph:
    """A network of osm nodes (osmid, x, y) and edges (u, v, length | travel_time[, geometry]).

    Lengths in metres become km; of parallel edges the lightest stays. Of travel times, the circuities become hours'
    seconds by the off-graph speed, or 0 and 240 without one. geometry is an array of (x, y) between the ends.
    """
    if weight not in ("length", "travel_time"):
        raise ValueError("weight is length or travel_time")
    ids = nodes.groupBy("osmid").agg(F.first("x").alias("x"), F.first("y").alias("y")).withColumn("band", F.pmod(F.xxhash64("osmid"), F.lit(1024)))
    # Ids follow the osm ids, within 1024 hash groups whose counts are summed up first.
    sizes = ids.groupBy("band").count().withColumn("k", F.lit(0)).withColumn("before", F.sum("count").over(Window.partitionBy("k").orderBy("band")) - F.col("count")).select(F.col("band").alias("b_band"), "before")
    ids = cut(ids.withColumn("at", F.row_number().over(Window.partitionBy("band").orderBy("osmid"))).join(sizes, F.col("band") == F.col("b_band")).select((F.col("before") + F.col("at") - 1).cast("long").alias("node_id"), "osmid", F.round("y", coordinate_places).alias("lat"), F.round("x", coordinate_places).alias("lon")))
    w = F.round(F.col(weight) / (1000.0 if weight == "length" else 1.0), weight_places)
    a, b = ids.select(F.col("osmid").alias("a"), F.col("node_id").alias("src")), ids.select(F.col("osmid").alias("b"), F.col("node_id").alias("dst"))
    e = edges.join(a, F.col("u") == F.col("a")).join(b, F.col("v") == F.col("b"))
    if shapes and "geometry" in edges.columns:
        pts = F.transform("geometry", lambda p: F.struct(F.round(p["y"], coordinate_places).alias("lat"), F.round(p["x"], coordinate_places).alias("lon")))
        out = lightest_rows(e.select("src", "dst", w.alias("weight"), pts.alias("shape")))
    else:
        out = lightest(e.select("src", "dst", w.alias("weight")))
    if weight == "length":
        return GeoGraph(out, ids.select("node_id", "lat", "lon"))
    off, add = (3600 / speed, 3600 / speed) if speed else (0.0, 240.0)
    return GeoGraph(out, ids.select("node_id", "lat", "lon"), off_graph_circuity=off, node_addition_circuity=add)


# ---- Routes


def line_path(routes: DataFrame, long_first: bool = False) -> DataFrame:
    """routes with `value`, their coordinate_path (lists) as a GeoJSON LineString."""
    pts = F.col("coordinate_path") if long_first else F.transform("coordinate_path", lambda p: F.array(p[1], p[0]))
    return routes.withColumn("value", F.to_json(F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates"))))


def route_features(graph: GeoGraph, queries: DataFrame, **options) -> DataFrame:
    """(query_id, value): a feature for each query; queries may have a map of properties."""
    from meshroute.operators.routing import route

    options = {"shapes": "shape" in graph.edges.columns} | options
    props = queries.select(F.col("query_id").alias("p_query"), F.coalesce("properties", F.expr("map()").cast("map<string,string>")).alias("properties")) if "properties" in queries.columns else queries.select(F.col("query_id").alias("p_query"), F.expr("map()").cast("map<string,string>").alias("properties"))
    r = route(graph, queries, **options).join(props, F.col("query_id") == F.col("p_query"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform("coordinate_path", lambda p: F.array(p[1], p[0])).alias("coordinates"))
    return r.select("query_id", F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", line.alias("geometry"))).alias("value"))


def check_name(name: str) -> str:
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError(f"{name!r} can't name a network")
    return name
