"""Dots in shapes with holes, parts and no area; text files with either line end."""

from __future__ import annotations

import pytest

from fieldtally.operators import spatial
from fieldtally.sources.files import read_delimited


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_dots_in_odd_shapes(spark):
    shapes = {
        1: [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)[::-1]], 2: [square(0.0, 0.0, 1.0), square(50.0, 0.0, 1.0)], 3: [[(0.0, 0.0), (4.0, 2.0), (0.0, 0.0)]],
        4: [[(7.0, 7.0), (7.0, 7.0), (7.0, 7.0)]], 5: [[(0.0, 1.0), (3.0, 1.0), (1.0, 1.0), (0.0, 1.0)]],
    }
    df = spark.createDataFrame([(k, r, 400) for k, r in shapes.items()], "k int, rings array<array<struct<x:double,y:double>>>, n int")
    got = spatial.dot_density(df, ["k"], "rings", "n", seed=3).collect()
    of = {k: [(r.x, r.y) for r in got if r.k == k] for k in shapes}
    assert all(len(v) == 400 for v in of.values())
    assert all(0 <= x <= 4 and 0 <= y <= 4 and not (1 < x < 3 and 1 < y < 3) for x, y in of[1])
    assert 120 < sum(x > 2 for x, _ in of[2]) < 280 and all(x <= 1 or 50 <= x <= 51 for x, _ in of[2])
    assert all(y == pytest.approx(x / 2) for x, y in of[3]) and len(set(of[3])) > 300
    assert set(of[4]) == {(7.0, 7.0)} and all(y == 1.0 and 0 <= x <= 3 for x, y in of[5])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_ends(spark, tmp_path, end):
    lines = ["a,b,c", '1,"two', 'lines",3', "4,plain,6"]
    (tmp_path / "f.csv").write_bytes(end.join([*lines, ""]).encode())
    got = read_delimited(spark, str(tmp_path / "f.csv"), "a int, b string, c int", multi_line=True).collect()
    assert [(r.a, r.c) for r in got] == [(1, 3), (4, 6)]
    assert got[0].b.replace("\r\n", "\n") == "two\nlines" and got[1].b == "plain"
