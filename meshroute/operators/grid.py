"""Grids with obstacles as graphs: cells, moves of a body that may not sweep over a blocked cell, and routes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshroute.functions import geodesy
from meshroute.operators import paths, relax
from meshroute.operators.model import Graph
from meshroute.session import cut

# The eight moves and their costs, and a body of one cell.
MOVES = [(0, 1, 1.0), (1, 0, 1.0), (0, -1, 1.0), (-1, 0, 1.0), (1, 1, 1.4142), (1, -1, 1.4142), (-1, 1, 1.4142), (-1, -1, 1.4142)]
BODY = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
FORMAT = 1
#: Legs that differ by less are equal.
TIE = 1e-9


def swept(body: list[tuple[float, float]], dx: int, dy: int) -> list[tuple[int, int]]:
    """The cells, relative to the start, that a body overlaps while it moves by (dx, dy).

    Across a diagonal move a point keeps its intercept y - (dy / dx) x; a cell of the bounding box is met if the
    intercepts of its corners and of the body's overlap in more than a point.
    """
    xs, ys = [p[0] for p in body], [p[1] for p in body]
    box = [(x, y) for x in range(int(min(xs) + min(0, dx)), math.ceil(max(xs) + max(0, dx))) for y in range(int(min(ys) + min(0, dy)), math.ceil(max(ys) + max(0, dy)))]
    if not dx or not dy:
        return box
    across = lambda points: [y - dy / dx * x for x, y in points]
    own = across(body)
    corners = lambda x, y: across([(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)])
    return [(x, y) for x, y in box if min(corners(x, y)) < max(own) and min(own) < max(corners(x, y))]


@dataclass(frozen=True)
class Grid:
    graph: Graph
    x_size: int
    y_size: int
    blocks: DataFrame

    def index(self, x: int, y: int) -> int:
        if not (0 <= x < self.x_size and 0 <= y < self.y_size):
            raise ValueError(f"({x}, {y}) is not on the grid")
        return x + y * self.x_size

    def place(self, node_id: int) -> tuple[int, int]:
        if not 0 <= node_id < self.x_size * self.y_size:
            raise ValueError(f"{node_id} is not on the grid")
        return node_id % self.x_size, node_id // self.x_size


def save(grid: Grid, path: str, include_blocks: bool = True) -> None:
    """The grid as a Parquet folder: edges, nodes, sizes and, unless left out, the blocked cells."""
    grid.graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    grid.graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    (grid.blocks if include_blocks else grid.blocks.limit(0)).write.mode("overwrite").parquet(f"{path}/blocks")
    grid.graph.spark.createDataFrame([(FORMAT, grid.x_size, grid.y_size)], "format int, x_size int, y_size int").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Grid:
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.format != FORMAT:
        raise ValueError(f"{path} has format {meta.format}, not {FORMAT}")
    return Grid(Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")), meta.x_size, meta.y_size, spark.read.parquet(f"{path}/blocks"))


def cells(spark: SparkSession, x_size: int, y_size: int) -> DataFrame:
    """(node_id, x, y), node_id = x + y * x_size."""
    return spark.range(x_size * y_size).select(F.col("id").alias("node_id"), (F.col("id") % x_size).cast("int").alias("x"), F.expr(f"cast(id div {x_size} as int)").alias("y"))


def build(spark: SparkSession, x_size: int, y_size: int, blocks: DataFrame | list, *, body=None, moves=None, walls: bool = True) -> Grid:
    """A grid with blocked cells (x, y), and the border too if walls are asked for.

    The moves and what they sweep are a table of a few rows, fixed by the body; a move is left out if its start is
    blocked or any cell it sweeps is.
    """
    body, moves = body or BODY, moves or MOVES
    if not isinstance(blocks, DataFrame):
        blocks = spark.createDataFrame([(int(x), int(y)) for x, y in blocks], "x int, y int")
    at = cells(spark, x_size, y_size)
    if walls:
        blocks = blocks.select(F.col("x").cast("int"), F.col("y").cast("int")).union(at.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == x_size - 1) | (F.col("y") == y_size - 1)).select("x", "y"))
    blocks = cut(blocks.select(F.col("x").alias("bx"), F.col("y").alias("by")).distinct())
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("weight")) for dx, dy, w in moves]))
    free = at.join(blocks, (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")), "left_anti")
    move = free.select("node_id", "x", "y", step.alias("m")).select("node_id", "x", "y", "m.*")
    move = move.where((F.col("x") + F.col("dx")).between(0, x_size - 1) & (F.col("y") + F.col("dy")).between(0, y_size - 1))
    sweeps = [(dx, dy, ox, oy) for dx, dy, _ in moves for ox, oy in swept(body, dx, dy)]
    sweep = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("sdx", "sdy", "ox", "oy"), s, strict=True)]) for s in sweeps]))
    hit = blocks.select("bx", "by", sweep.alias("s")).select((F.col("bx") - F.col("s.ox")).alias("hx"), (F.col("by") - F.col("s.oy")).alias("hy"), F.col("s.sdx").alias("sdx"), F.col("s.sdy").alias("sdy")).distinct()
    ok = move.join(hit, (F.col("x") == F.col("hx")) & (F.col("y") == F.col("hy")) & (F.col("dx") == F.col("sdx")) & (F.col("dy") == F.col("sdy")), "left_anti")
    edges = ok.select(F.col("node_id").alias("src"), (F.col("node_id") + F.col("dx") + F.col("dy") * x_size).alias("dst"), "weight")
    nodes = at.select("node_id", F.col("x").cast("double").alias("lat"), F.col("y").cast("double").alias("lon"))
    return Grid(Graph(cut(edges), nodes), x_size, y_size, blocks)


def blocked_moves(grid: Grid, moves=None) -> DataFrame:
    """(src, dst) of the moves within the grid that aren't edges."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy, _ in moves or MOVES]))
    every = cells(grid.graph.spark, grid.x_size, grid.y_size).select("node_id", "x", "y", step.alias("m"))
    every = every.where((F.col("x") + F.col("m.dx")).between(0, grid.x_size - 1) & (F.col("y") + F.col("m.dy")).between(0, grid.y_size - 1)).select(F.col("node_id").alias("src"), (F.col("node_id") + F.col("m.dx") + F.col("m.dy") * grid.x_size).alias("dst"))
    e = grid.graph.edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    return every.join(e, (F.col("src") == F.col("e_src")) & (F.col("dst") == F.col("e_dst")), "left_anti")


def snap(grid: Grid, points: DataFrame) -> DataFrame:
    """(point_id, node_id, leg) of points (point_id, x, y): the nearest corner of the lattice that has out-edges.

    A point on the lattice is its own cell, whatever its edges. node_id is null where no corner will do. Ties go to
    the corner lower in x and y, then the one further in x, then in y; corners are equally far if their legs differ by less
    than TIE, as the last digits of a leg hang on how it was reckoned.
    """
    open_ = grid.graph.edges.select(F.col("src").alias("open_id")).distinct()
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)])]))
    on = (F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y"))
    p = points.select("point_id", "x", "y", on.alias("on"), corner.alias("c")).where(~F.col("on") | (F.col("c.order") == 0))
    p = p.select("*", (F.floor("x") + F.col("c.dx")).alias("cx"), (F.floor("y") + F.col("c.dy")).alias("cy")).where(F.col("cx").between(0, grid.x_size - 1) & F.col("cy").between(0, grid.y_size - 1))
    p = p.withColumn("cell", (F.col("cx") + F.col("cy") * grid.x_size).cast("long")).join(open_, F.col("cell") == F.col("open_id"), "left").where(F.col("on") | F.col("open_id").isNotNull())
    corners = F.collect_list(F.struct(F.col("c.order").alias("order"), "cell", geodesy.euclidean("x", "y", "cx", "cy").alias("leg")))  # four at most
    best = p.groupBy(F.col("point_id").alias("b_id")).agg(corners.alias("k")).withColumn("leg", F.array_min(F.transform("k", lambda c: c["leg"])))
    best = best.select("b_id", "leg", F.array_min(F.filter("k", lambda c: c["leg"] < F.col("leg") + TIE))["cell"].alias("cell"))
    return points.join(best, F.col("point_id") == F.col("b_id"), "left").select("point_id", F.col("cell").alias("node_id"), "leg")


def route(grid: Grid, queries: DataFrame, strategy="dijkstra", form: str = "list_of_dicts") -> DataFrame:
    """(query_id, length, path, coordinate_path) of queries (query_id, ox, oy, dx, dy).

    Ends off the lattice are in the coordinates and count in the length; their place in the path is -1. Where an end
    has no cell with a way out, or no way leads, all is null.
    """
    q = cut(queries.select("query_id", *[F.col(c).cast("double").alias(c) for c in ("ox", "oy", "dx", "dy")]))
    a = snap(grid, q.select(F.col("query_id").alias("point_id"), F.col("ox").alias("x"), F.col("oy").alias("y"))).toDF("a_id", "a", "a_leg")
    b = snap(grid, q.select(F.col("query_id").alias("point_id"), F.col("dx").alias("x"), F.col("dy").alias("y"))).toDF("b_id", "b", "b_leg")
    open_ = grid.graph.edges.select(F.col("src").alias("open_id")).distinct()
    ends = cut(q.join(a, F.col("query_id") == F.col("a_id")).join(b, F.col("query_id") == F.col("b_id")).join(open_, F.col("a") == F.col("open_id"), "left_semi").join(open_, F.col("b") == F.col("open_id"), "left_semi"))
    origins = ends.select(F.col("a").alias("origin_id")).distinct()
    dist = cut(relax.strategy_named(strategy)(grid.graph.edges, relax.seeds_of(origins)))
    tree = cut(relax.predecessors(grid.graph.edges, dist, origins.select("origin_id", F.col("origin_id").alias("node"))))
    got = paths.tree_paths(tree, ends.select("query_id", F.col("a").alias("origin_id"), F.col("b").alias("destination_id"))).withColumnsRenamed({"query_id": "g_id", "length": "g_length", "path": "g_path"})
    rows = q.join(ends.select(F.col("query_id").alias("e_id"), "a_leg", "b_leg"), F.col("query_id") == F.col("e_id"), "left").join(got, F.col("query_id") == F.col("g_id"), "left")
    off = lambda leg: F.when(F.col(leg) > 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    xy = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    inner = F.transform("g_path", lambda n: xy(n % grid.x_size, F.floor(n / grid.x_size)))
    tip = lambda leg, x, y: F.when(F.col(leg) > 0, F.array(xy(F.col(x), F.col(y)))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    way = F.concat(tip("a_leg", "ox", "oy"), inner, tip("b_leg", "dx", "dy"))
    if form == "list_of_dicts":
        shown = way
    elif form in ("list_of_lists", "list_of_tuples"):
        shown = F.transform(way, lambda p: F.array(p["x"], p["y"]))
    else:
        raise ValueError(f"unknown form {form!r}")
    return rows.select("query_id", (F.col("g_length") + F.col("a_leg") + F.col("b_leg")).alias("length"), F.concat(off("a_leg"), "g_path", off("b_leg")).alias("path"), shown.alias("coordinate_path"))
