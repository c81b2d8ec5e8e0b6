"""Line simplification after Visvalingam and Whyatt: of the inner points, the one of least weight goes first.

Within a line the order of removals is sequential; lines are independent, so each goes to one task as an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]


def area(a: Point, b: Point, c: Point) -> float:
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1]))


def shorter_edge(a: Point, b: Point, c: Point) -> float:
    return min((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, (c[0] - b[0]) ** 2 + (c[1] - b[1]) ** 2)


def area_plus_edge(a: Point, b: Point, c: Point) -> float:
    return area(a, b, c) + shorter_edge(a, b, c)


WEIGHTS = {f.__name__: f for f in (area, shorter_edge, area_plus_edge)}


def simplify_line(points: list[Point], pct_to_keep: float, min_points: int = 2, weight: Callable[[Point, Point, Point], float] = area) -> list[Point]:
    """The points that stay; both ends always do. Ties go to the earlier point."""
    if not 0 <= pct_to_keep <= 100:
        raise ValueError("pct_to_keep is from 0 to 100")
    n = len(points)
    drop = n - max(round((n - 2) * pct_to_keep / 100) + 2, min_points)
    if drop <= 0:
        return list(points)
    around = {i: (i - 1, i + 1) for i in range(1, n - 1)}
    queue = [(weight(points[i - 1], points[i], points[i + 1]), i, i - 1, i + 1) for i in around]
    heapify(queue)
    while drop and queue:
        _, i, left, right = heappop(queue)
        if around.get(i) != (left, right):
            continue  # gone, or its neighbours have changed since
        del around[i]
        drop -= 1
        for j, pair in ((left, lambda old: (old[0], right)), (right, lambda old: (left, old[1]))):
            if j in around:
                around[j] = a, b = pair(around[j])
                heappush(queue, (weight(points[a], points[j], points[b]), j, a, b))
    return [p for i, p in enumerate(points) if i in (0, n - 1) or i in around]


def clean_lines(vertices: DataFrame) -> DataFrame:
    """(line_id, seq, x, y) without vertices equal to the one before, and without lines of a single point."""
    from pyspark.sql import Window

    order = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.select("line_id", "seq", "x", "y", F.lag("x").over(order).alias("px"), F.lag("y").over(order).alias("py"))
    v = v.where(F.col("px").isNull() | (F.col("px") != F.col("x")) | (F.col("py") != F.col("y")))
    return v.withColumn("n", F.count("*").over(Window.partitionBy("line_id"))).where("n > 1").select("line_id", "seq", "x", "y")


def simplify_lines(vertices: DataFrame, pct_to_keep: float, min_points: int = 2, weight: str | Callable = "area") -> DataFrame:
    """(line_id, seq, x, y) of the vertices that stay, numbered anew."""
    fn = WEIGHTS[weight] if isinstance(weight, str) else weight
    lines = vertices.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p")).select(F.col("line_id").cast("long").alias("line_id"), F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, xs, ys = [], [], [], []
            for line, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (a, b) in enumerate(simplify_line(list(zip(x, y, strict=True)), pct_to_keep, min_points, fn)):
                    ids.append(line)
                    seqs.append(k)
                    xs.append(a)
                    ys.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int32()), pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["line_id", "seq", "x", "y"])

    return lines.mapInArrow(run, "line_id long, seq int, x double, y double")
