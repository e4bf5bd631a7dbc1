"""Centroids from a vertex table: what a task holds."""

from fieldtally.operators import spatial


def test_edges_are_dealt_before_they_are_grouped(spark):
    """No task that reads vertices may hold a table of their edges."""
    made = [(g, 0, i, x, y) for g in (1, None) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    df = spark.createDataFrame(made, "geo long, part int, seq int, x double, y double")
    out = spatial.vertex_centroids(df, "geo", "part", "seq")
    assert {r.geo: (r.area, r.cx, r.cy) for r in out.collect()} == {g: (2.0, 1.0, 0.5) for g in (1, None)}
    plan = out._jdf.queryExecution().sparkPlan().toString().split("\n")
    scan, exchange = len(plan), next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    assert not any("Aggregate" in line for line in plan[exchange:scan])
