"""Mistake-driven learners against a NumPy run of the same order."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import online


@pytest.mark.parametrize("most", [None, 0.3])
def test_same_as_numpy(spark, most):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))] + [(999, None, 0.0, 0.0, 1)], "id long, a double, b double, c double, y int")
    got = online.fit_online(df.repartition(7), ["a", "b", "c"], "y", "id", F.col("id") % 5, 3, epochs=4, most=most)
    full, signs, w = np.column_stack([np.ones(240), x]), np.where(y > 0, 1.0, -1.0), np.zeros(4)
    for _ in range(4):
        ends = []
        for part in range(5):
            now = w.copy()
            for i in range(part, 240, 5):
                margin = signs[i] * (now @ full[i])
                step = float(margin <= 0) if most is None else min(most, max(0.0, 1 - margin) / (full[i] @ full[i]))
                now += step * signs[i] * full[i]
            ends.append(now)
        w = np.mean(ends, axis=0)
    assert np.allclose(got.weights, w)
    right = got.apply(df).where("prediction = y").count()
    assert right >= 216 and got.apply(df).where("prediction IS NULL").count() == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, a double, y int")
    assert online.fit_online(df, ["a"], "y", "id", "id", 2).weights == [0.0, 0.0]
