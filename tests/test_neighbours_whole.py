"""Every row is fitted, however many there are, and the fitted rows are looked through block by block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import neighbours


def test_no_row_is_left_out_above_fifty_thousand(spark):
    df = spark.range(60_000).select("id", F.array(F.col("id").cast("double")).alias("v"), (F.col("id") * 2).alias("y"))
    asked = df.where("id % 2000 = 7")
    got = neighbours.nearest_neighbours(asked, df, "id", "v", 3, "y", exclude_self=True).collect()
    assert {(r.qid, r.place): (r.pid, r.payload, r.distance) for r in got} == {
        (i, k): (j, 2 * j, abs(j - i) * 1.0) for i in range(7, 60_000, 2000) for k, j in ((1, i - 1), (2, i + 1), (3, i - 2))
    }


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("named", [True, False])
def test_blocks_make_up_the_whole(spark, monkeypatch, p, exclude_self, named):
    monkeypatch.setattr(neighbours, "ROWS_OF_BLOCK", 7)
    monkeypatch.setattr(neighbours, "ROWS_READ", 5)
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(120, 3)) * 3)  # many ties and copies
    name = (lambda i: f"n{i:03d}") if named else (lambda i: i)
    df = spark.createDataFrame([(name(i), i % 3 if i % 4 else None, x.tolist()) for i, x in enumerate(v)], f"id {'string' if named else 'long'}, y int, v array<double>")
    found = neighbours.nearest_neighbours(df.repartition(6), df.repartition(5), "id", "v", 9, "y", p, exclude_self).collect()
    got = {(r.qid, r.place): (r.pid, r.payload, round(r.distance, 9)) for r in found}
    assert len(got) == len(found) == 120 * 9
    for q in range(120):
        d = np.abs(v - v[q]).sum(axis=1) if p == 1 else np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [i for i in sorted(range(120), key=lambda i: (d[i], i)) if not (exclude_self and i == q)][:9]
        assert [got[name(q), k + 1] for k in range(9)] == [(name(i), i % 3 if i % 4 else None, round(float(d[i]), 9)) for i in order]
