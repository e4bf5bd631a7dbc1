"""Polygon jobs on polygons derived from the tables' keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import spatial
from ..sources.files import table
from .registry import query


def regular_ring(x: Column, y: Column, radius: Column, corners: Column) -> Column:
    """A closed regular polygon as an array of vertices."""
    def corner(i):
        angle = F.lit(2 * math.pi) * (i % corners) / corners
        return F.struct((x + radius * F.cos(angle)).alias("x"), (y + radius * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), corners), corner)


def plots(spark, sf, name: str, key: str):
    """One polygon per customer or supplier, placed and sized by its key."""
    k = F.col(key)
    corners = (F.lit(3) + k % 7).cast("int")
    return table(spark, sf, name).select(
        key, corners.alias("corners"),
        regular_ring((k % 100) * 10.0, (k % 37) * 10.0, 1.0 + (k % 5), corners).alias("ring"),
    )


_CENTROID_SQL = """SELECT c_custkey, round(0.5 * n * r * r * sin(2 * pi() / n), 6) AS area, round(x, 6) + 0.0 AS cx, round(y, 6) + 0.0 AS cy
  FROM (SELECT c_custkey, 3 + c_custkey % 7 AS n, 1.0::DOUBLE + c_custkey % 5 AS r, (c_custkey % 100) * 10.0::DOUBLE AS x,
               (c_custkey % 37) * 10.0::DOUBLE AS y FROM customer)"""


@query("polygon_centroid", _CENTROID_SQL)
def polygon_centroid(spark, sf):
    """From a vertex table: edges meet by key, so a giant ring is no single task's work."""
    vertices = plots(spark, sf, "customer", "c_custkey").select("c_custkey", F.posexplode("ring").alias("seq", "v"))
    flat = vertices.select("c_custkey", F.lit(0).alias("ring"), "seq", "v.x", "v.y")
    out = spatial.vertex_centroids(flat, "c_custkey", "ring", "seq")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("cx", "cy")})


@query("ring_centroid", _CENTROID_SQL)
def ring_centroid(spark, sf):
    """The same from one geometry value per row, without a shuffle."""
    out = spatial.ring_centroids(plots(spark, sf, "customer", "c_custkey"), "ring", ["c_custkey"])
    return out.withColumns({c: F.col(c) + 0.0 for c in ("cx", "cy")})


@query(
    "dot_density",
    """SELECT s_suppkey, l_returnflag AS kind, n AS dots, n AS inside, n AS places FROM (
         SELECT s_suppkey, l_returnflag, CAST(round_even(count(*) / 5, 0) AS BIGINT) AS n
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) WHERE n > 0""",
)
def dot_density(spark, sf):
    """One dot for five line items, per supplier polygon and return flag.

    The result counts the dots, the dots inside (by half-planes, not by the sampler's own
    test) and the different places, since the points themselves are random.
    """
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("kind")).agg(
        numeric.half_even(F.count(F.lit(1)) / 5).cast("long").alias("n")
    )
    shapes = plots(spark, sf, "supplier", "s_suppkey")
    dots = spatial.dot_density(counts.join(shapes, "s_suppkey"), ["s_suppkey", "kind"], "ring", "n", seed=7)
    edges = shapes.select("s_suppkey", spatial.ring_edges("ring").alias("edges"))

    def left_of(e):
        return (e["b"]["x"] - e["a"]["x"]) * (F.col("y") - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (F.col("x") - e["a"]["x"]) >= -1e-9

    checked = dots.join(edges, "s_suppkey").withColumn("ok", F.forall("edges", left_of))
    place = checked.groupBy("s_suppkey", "kind", "x", "y").agg(F.count(F.lit(1)).alias("d"), F.count_if("ok").alias("i"))
    return place.groupBy("s_suppkey", "kind").agg(
        F.sum("d").alias("dots"), F.sum("i").alias("inside"), F.count(F.lit(1)).alias("places")
    )


_PARTS = 12


@query(
    "dot_density_parts",
    f"""SELECT s_suppkey, n AS dots, n AS inside, n AS places FROM (
         SELECT s_suppkey, CAST(count(*) // {_PARTS} AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) WHERE n > 0""",
)
def dot_density_parts(spark, sf):
    """Shapes with a hole and a second part; every third one is a line without area.  Checked by plain comparisons."""
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.floor(F.count(F.lit(1)) / _PARTS).cast("long").alias("n"))
    x0 = (F.col("s_suppkey") % 100) * 10.0

    def box(x, y, side, turned=False):
        corners = [(0, 0), (0, side), (side, side), (side, 0), (0, 0)] if turned else [(0, 0), (side, 0), (side, side), (0, side), (0, 0)]
        return F.array(*[F.struct((x + float(a)).alias("x"), F.lit(float(y + b)).alias("y")) for a, b in corners])

    frame = F.array(box(x0, 0, 4), box(x0 + 1.0, 1, 2, turned=True), box(x0 + 6.0, 0, 2))
    line = F.array(F.array(*[F.struct((x0 + dx).alias("x"), F.lit(1.0).alias("y")) for dx in (0.0, 5.0, 2.0, 0.0)]))
    flat = F.col("s_suppkey") % 3 == 0
    shapes = table(spark, sf, "supplier").select("s_suppkey", F.when(flat, line).otherwise(frame).alias("rings"))
    dots = spatial.dot_density(counts.join(shapes, "s_suppkey"), ["s_suppkey"], "rings", "n", seed=11)
    x, y = F.col("x") - x0, F.col("y")
    outer = x.between(0, 4) & y.between(0, 4) & ~((x > 1) & (x < 3) & (y > 1) & (y < 3))
    ok = F.when(flat, (y == 1.0) & x.between(0, 5)).otherwise(outer | (x.between(6, 8) & y.between(0, 2)))
    place = dots.withColumn("ok", ok).groupBy("s_suppkey", "x", "y").agg(F.count(F.lit(1)).alias("d"), F.count_if("ok").alias("i"))
    return place.groupBy("s_suppkey").agg(F.sum("d").alias("dots"), F.sum("i").alias("inside"), F.count(F.lit(1)).alias("places"))
