"""Polygon centroids and dot density as table jobs.

A polygon is one row with its closed ring as ``array<struct<x: double, y: double>>``, the
way a spatial frame keeps a geometry per row.  Rings can also come as a vertex table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.nulls import safe_ratio


def ring_edges(ring: str | Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(ring)
    heads, tails = F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1)
    return F.zip_with(heads, tails, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _edge_sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def ring_centroids(df: DataFrame, ring: str, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Area and centroid of each row's ring; no shuffle."""
    edges = F.col("__edges")
    area2 = _edge_sum(edges, _cross)
    cx = _edge_sum(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e))
    cy = _edge_sum(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e))
    return df.select(*keys, ring_edges(ring).alias("__edges")).select(
        *keys,
        F.round(F.abs(area2) / 2, digits).alias("area"),
        F.round(safe_ratio(cx, 3 * area2), digits).alias("cx"),
        F.round(safe_ratio(cy, 3 * area2), digits).alias("cy"),
    )


def vertex_centroids(
    vertices: DataFrame, geo: str, ring: str, seq: str, x: str = "x", y: str = "y", digits: int = 6
) -> DataFrame:
    """The same from a vertex table of closed rings (several rings add up, holes wind the other way).

    A vertex serves the edge it starts and the edge it ends; the two halves meet by
    (geo, ring, edge), so even one giant ring is spread over all tasks, and a task holds the edges dealt to it only.
    """
    halves = vertices.select(
        geo, ring, x, y,
        F.explode(F.array(F.struct(F.col(seq).alias("edge"), F.lit(True).alias("start")),
                          F.struct((F.col(seq) - 1).alias("edge"), F.lit(False).alias("start")))).alias("h"),
    ).select(geo, ring, "h.edge", "h.start", x, y)
    is_start = F.col("start")
    # dealt before they are grouped: a task that reads the vertices would hold all their edges, as no two of its halves need meet
    edges = halves.repartition(geo, ring, "edge").groupBy(geo, ring, "edge").agg(
        F.max(F.when(is_start, F.col(x))).alias("x0"), F.max(F.when(is_start, F.col(y))).alias("y0"),
        F.max(F.when(~is_start, F.col(x))).alias("x1"), F.max(F.when(~is_start, F.col(y))).alias("y1"),
    ).where("x0 is not null and x1 is not null")
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sums = edges.groupBy(geo).agg(
        F.sum(cross).alias("a2"),
        F.sum((F.col("x0") + F.col("x1")) * cross).alias("sx"),
        F.sum((F.col("y0") + F.col("y1")) * cross).alias("sy"),
    )
    return sums.select(
        geo,
        F.round(F.abs(F.col("a2")) / 2, digits).alias("area"),
        F.round(safe_ratio("sx", 3 * F.col("a2")), digits).alias("cx"),
        F.round(safe_ratio("sy", 3 * F.col("a2")), digits).alias("cy"),
    )


def point_in_ring(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd rule: does a ray to the right cross an odd number of edges?"""
    def crosses(e):
        spans = (e["a"]["y"] > py) != (e["b"]["y"] > py)
        at = e["a"]["x"] + (py - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"])
        return F.when(spans, px < at).otherwise(F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))


def unit_noise(*parts: str | Column) -> Column:
    """A repeatable number in [0, 1) from a hash of the arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def dot_density(
    df: DataFrame, keys: Sequence[str], ring: str, dots: str, seed: int = 0, chunk: int = 1024
) -> DataFrame:
    """``dots`` random points inside each row's polygon: (keys, dot, x, y).

    ``ring`` holds one closed ring, or an array of them: several parts, and holes, which lie inside an odd number of other
    rings (a point is inside the shape if a ray from it crosses an odd number of edges of all rings).  A shape
    without an area has its dots on its edges, by their length.

    A row is cut into chunks of at most ``chunk`` dots and the chunks are spread over all
    tasks, so one heavy polygon is not one task's work.  Each dot draws its own hash-based
    candidates in the bounding box until one falls inside; dots never need to be counted or
    ranked per polygon.  Draws come in growing batches that are only evaluated when the
    batch before missed, and the number allowed follows the polygon's fill of its box, so
    that the chance of running out is about e^-40 per dot; such a dot takes a place on the
    edges, which keeps the count exact.
    """
    several = isinstance(df.schema[ring].dataType.elementType, ArrayType)
    rings = F.filter(ring, lambda r: F.size(r) > 1) if several else F.array(ring)
    points = F.flatten(rings) if several else F.col(ring)
    edges_of = F.flatten(F.transform(rings, ring_edges))
    xs, ys = F.transform(points, lambda v: v["x"]), F.transform(points, lambda v: v["y"])
    width, height = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    # holes take away at least as much as their winding says; a thin frame may need more draws than a full shape
    whole = F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + F.abs(_edge_sum(ring_edges(r), _cross)))
    signed = F.abs(_edge_sum(F.col("__edges"), _cross))
    with_box = df.where(F.col(dots) > 0).select(
        *keys, dots, edges_of.alias("__edges"), whole.alias("__whole"),
        F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"),
    )
    fill = F.try_divide(F.least(signed, F.col("__whole")) / 2, width * height)
    flat = F.coalesce(fill <= 1e-12, F.lit(True))
    tries = F.when(flat, F.lit(0)).otherwise(F.least(F.greatest(F.lit(8), F.ceil(F.lit(40.0) / fill)), F.lit(1_000_000_000))).cast("int")
    chunks = F.sequence(F.lit(0).cast("long"), ((F.col(dots) - 1) / F.lit(chunk)).cast("long"))
    spread = (
        with_box.withColumn("__tries", tries)
        .withColumn("__chunk", F.explode(chunks))
        .repartition(*keys, "__chunk")
    )
    first = F.col("__chunk") * chunk + 1
    last = F.least(first + (chunk - 1), F.col(dots).cast("long"))
    each = spread.withColumn("dot", F.explode(F.sequence(first, last)))

    def draw(i):
        return F.struct(
            (F.col("__x0") + width * unit_noise(*keys, "dot", i, F.lit(2 * seed))).alias("x"),
            (F.col("__y0") + height * unit_noise(*keys, "dot", i, F.lit(2 * seed + 1))).alias("y"),
        )

    def batch(lo, hi):
        candidates = F.transform(F.sequence(lo, hi), draw)
        return F.get(F.filter(candidates, lambda p: point_in_ring(p["x"], p["y"], F.col("__edges"))), F.lit(0))

    def length(e):
        return F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], F.lit(2)) + F.pow(e["b"]["y"] - e["a"]["y"], F.lit(2)))

    # a place on the edges: the first edge at which their lengths so far reach a share of the whole
    aim = _edge_sum(F.col("__edges"), length) * unit_noise(*keys, "dot", F.lit(-1), F.lit(seed))
    start = F.struct(F.lit(0.0).alias("so_far"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))

    def walk(acc, e):
        share = F.least(F.greatest(F.coalesce(F.try_divide(aim - acc["so_far"], length(e)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        here = F.struct((e["a"]["x"] + share * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + share * (e["b"]["y"] - e["a"]["y"])).alias("y"))
        return F.struct((acc["so_far"] + length(e)).alias("so_far"), F.when(acc["p"].isNull() & (acc["so_far"] + length(e) >= aim), here).otherwise(acc["p"]).alias("p"))

    on_edge = F.aggregate("__edges", start, walk, lambda acc: acc["p"])
    inside = F.coalesce(batch(F.lit(1), F.lit(2)), batch(F.lit(3), F.lit(8)), batch(F.lit(9), F.col("__tries") + 8))
    point = F.coalesce(F.when(F.col("__tries") > 0, inside), on_edge)
    return each.select(*keys, "dot", point.alias("__p")).select(*keys, "dot", "__p.x", "__p.y")
