"""Components by prefix against NumPy."""

from __future__ import annotations

import numpy as np

from fieldtally.operators import components


def test_blocks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)), rng.normal(size=(200, 2)) * [1, 50] + [3, -2]
    rows = [(i, *map(float, x), *map(float, y), 7.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "i long, q_a double, q_b double, q_c double, z_1 double, z_2 double, z_const double")
    groups = components.by_prefix(df.columns, ["q_", "z_", "none"])
    assert groups == {"q_": ["q_a", "q_b", "q_c"], "z_": ["z_1", "z_2", "z_const"]}
    blocks = components.fit_blocks(df, groups, 2)
    out = components.bind_scores(df, blocks, drop=True)
    assert out.columns == ["i", "q__PC1", "q__PC2", "z__PC1", "z__PC2"]
    got = np.array([tuple(r) for r in out.orderBy("i").collect()])[:, 1:]
    for data, mine in ((a, got[:, :2]), (b, got[:, 2:])):
        z = (data - data.mean(axis=0)) / data.std(axis=0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        want = z @ vt[:2].T
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-8)
        assert np.allclose(mine.var(axis=0), (s[:2] ** 2) / len(z))
    assert all(b.loadings[np.abs(b.loadings[:, k]).argmax(), k] > 0 for b in blocks.values() for k in range(2))


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (2.0, 4.0), (3.0, 6.5)], "x_a double, x_b double")
    blocks = components.fit_blocks(df, {"x": ["x_a", "x_b"]}, 2)
    assert abs(blocks["x"].means[1] - 12.5 / 3) < 1e-12
    assert [r.x_PC1 is None for r in components.bind_scores(df, blocks).collect()] == [False, True, False, False]
    none = components.fit_blocks(df.where("x_a > 9"), {"x": ["x_a", "x_b"]}, 2)
    assert components.bind_scores(df.where("x_a > 9"), none).count() == 0
