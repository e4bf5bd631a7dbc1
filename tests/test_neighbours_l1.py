"""City-block neighbours: first in single precision, then exactly among those that may be nearest."""

import numpy as np
import pytest

from fieldtally.operators import neighbours


def test_rough_distances_are_within_their_error():
    rng = np.random.default_rng(2)
    points, x = rng.normal(size=(5000, 17)) * 100, rng.normal(size=(70, 17))
    rough, slack = neighbours._about_l1(x, np.ascontiguousarray(points.T, np.float32))
    exact = np.abs(x[:, None, :] - points[None, :, :]).sum(axis=-1)
    assert rough.dtype == np.float32 and (2 * np.abs(rough - exact) <= slack[:, None]).all() and (slack < 1e-2 * exact.mean()).all()


@pytest.mark.parametrize("offset, step", [(0.0, 1.0), (1e7, 1e-3), (1e33, 1e30), (0.0, 1e-12)])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_nearest_equal_brute_force(spark, offset, step, exclude_self):
    rng = np.random.default_rng(4)
    v = offset + step * np.round(rng.normal(size=(150, 3)) * 4)  # many ties and copies
    df = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, y int, v array<double>")
    found = neighbours.nearest_neighbours(df, df, "id", "v", 4, "y", 1, exclude_self).collect()
    got = {(r.qid, r.place): (r.pid, r.distance) for r in found}
    assert len(got) == len(found) == 600
    for q in range(150):
        d = np.abs(v - v[q]).sum(axis=-1)
        order = [i for i in sorted(range(150), key=lambda i: (d[i], i)) if not (exclude_self and i == q)][:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, d[i]) for i in order]


def test_one_file_is_asked_in_many_tasks(spark):
    df = spark.createDataFrame([(i if i % 5 else None, i % 3, [float(i)]) for i in range(200)], "id long, y int, v array<double>").coalesce(1)
    points = df.where("id IS NOT NULL")
    found = neighbours.nearest_neighbours(df, points, "id", "v", 1, "y", 1)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 200
