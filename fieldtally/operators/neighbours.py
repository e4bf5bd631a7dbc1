"""k-nearest neighbours among the fitted rows, exact however many these are.

The fitted rows are stored in the shared folder in the order of their ids.  Every task takes a part of the asked rows,
dealt once by a hash, and goes through the stored rows block by block; an asked row keeps its k nearest so far, whose
last distance bounds what a later block may add.  So a task holds one batch of asked rows and one block, the driver none.
The work is the product of asked and fitted rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path

#: Numbers that one block of distances, or of fitted rows, may hold.
CELLS = 4_000_000
#: Fitted rows of a block, and rows decoded at once.
ROWS_OF_BLOCK, ROWS_READ = 16_384, 1024
TASKS_A_CORE = 4
#: A tile of single-precision distances that stays in a core's cache.
ROWS_OF_TILE, COLUMNS_OF_TILE = 32, 2048
#: Beyond this size single precision could overflow in a sum.
LARGEST = 1e30


def _exact(x: np.ndarray, points: np.ndarray, p: int) -> np.ndarray:
    """Distances of paired rows (the last axis is summed)."""
    gap = points - x
    return np.abs(gap).sum(axis=-1) if p == 1 else np.sqrt((gap * gap).sum(axis=-1))


def _about_l1(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of absolute differences in single precision, a small tile at a time, and twice their largest error for each row of x.

    ``points`` has a row for each dimension.
    """
    dims, n = points.shape
    out = np.empty((len(x), n), np.float32)
    mine = x.astype(np.float32).T
    gap = np.empty((ROWS_OF_TILE, COLUMNS_OF_TILE), np.float32)
    for top in range(0, len(x), ROWS_OF_TILE):
        for left in range(0, n, COLUMNS_OF_TILE):
            tile = out[top : top + ROWS_OF_TILE, left : left + COLUMNS_OF_TILE]
            t = gap[: tile.shape[0], : tile.shape[1]]
            total = np.zeros_like(t)
            for d in range(dims):
                np.maximum(mine[d, top : top + ROWS_OF_TILE, None], points[d, None, left : left + COLUMNS_OF_TILE], out=t)
                total += t
            total += total  # |a - b| = 2 max(a, b) - a - b
            total -= mine[:, top : top + ROWS_OF_TILE].sum(axis=0)[:, None]
            total -= points[:, left : left + COLUMNS_OF_TILE].sum(axis=0)[None, :]
            tile[:] = total
    size = np.abs(x).sum(axis=1) + np.abs(points.astype(np.float64)).sum(axis=0).max()
    return out, 8 * (dims + 4) * 2.0**-24 * size + 1e-30


def _plain(column) -> np.ndarray:
    """A column of Arrow as an array; whole numbers stay whole beside missing ones."""
    return column.to_pandas(integer_object_nulls=True).to_numpy()


def _blocks(path: str, most: int, read: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, payload, vectors) of the rows stored in ``path``, in their order, at most ``most`` rows and ``cells`` numbers at once."""
    system, folder = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))
    held, rows = [], 0
    for name in files:
        with system.open_input_file(name) as file, pq.ParquetFile(file, buffer_size=1 << 20) as found:
            for batch in found.iter_batches(batch_size=read, columns=["i", "y", "v"], use_threads=False):
                if not len(batch):
                    continue
                ids, payload = _plain(batch.column("i")), _plain(batch.column("y"))
                vectors = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                room = max(1, min(most, cells // max(1, vectors.shape[1])))
                for at in range(0, len(ids), room):
                    part = slice(at, at + room)
                    if held and rows + len(ids[part]) > room:
                        yield tuple(map(np.concatenate, zip(*held)))
                        held, rows = [], 0
                    held.append((ids[part], payload[part], vectors[part]))
                    rows += len(ids[part])
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _leave_out(rough: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
    """Infinite distances between rows and the fitted rows (in the order of their ids) of the same id."""
    if own.dtype.kind in "iu" and ids.dtype.kind in "iu":
        for r, (low, top) in enumerate(zip(np.searchsorted(ids, own), np.searchsorted(ids, own, "right"))):
            rough[r, low:top] = np.inf
    else:
        rough[own[:, None] == ids[None, :]] = np.inf


@dataclass
class _Block:
    """Fitted rows, and what the distances to them need."""

    ids: np.ndarray
    payload: np.ndarray
    points: np.ndarray
    p: int

    def __post_init__(self):
        self.small = None
        if self.p == 1:
            if np.abs(self.points).max(initial=0.0) < LARGEST:  # no missing value is below it
                self.centre = self.points.mean(axis=0)  # differences stay, rounding errors shrink with the sizes
                self.small = np.ascontiguousarray((self.points - self.centre).T, np.float32)
            return
        squares = (self.points * self.points).sum(axis=1)
        self.largest = squares.max(initial=0.0, where=np.isfinite(squares))
        self.beside = np.vstack([self.points.T, squares])

    def candidates(self, x: np.ndarray, own: np.ndarray | None, k: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, fitted row) pairs that are for certain all of the k nearest that lie within ``last``."""
        aside = 0.0
        if self.small is not None and np.abs(x).max(initial=0.0) < LARGEST:
            rough, slack = _about_l1(x - self.centre, self.small)
        elif self.p == 1:
            rough, slack = np.concatenate([_exact(row, self.points, 1)[None, :] for row in x]), np.zeros(len(x))
        else:  # squared distances but for the row's own square, by one matrix product; its rounding errors are far below the slack
            aside = (x * x).sum(axis=1)
            rough = np.hstack([-2.0 * x, np.ones((len(x), 1))]) @ self.beside
            slack, last = 1e-9 * (aside + self.largest), last * last
        if own is not None:
            _leave_out(rough, own, self.ids)
        bound = last - aside
        if not np.isfinite(last).all():
            rough[~np.isfinite(rough)] = np.inf
            need = min(k, len(self.ids))
            bound = np.fmin(np.partition(rough, need - 1, axis=1)[:, need - 1], bound)
        row, col = np.nonzero(rough <= (bound + slack)[:, None])
        real = np.isfinite(rough[row, col])
        return row[real], col[real]


@dataclass
class Neighbours:
    """Fitted rows, stored in ascending order of their ids."""

    path: str
    types: tuple[str, str]

    @property
    def ids(self) -> np.ndarray:
        return np.concatenate([np.empty(0, int), *(ids for ids, _, _ in _blocks(self.path, ROWS_OF_BLOCK, ROWS_READ, CELLS))])

    def nearest(self, queries: DataFrame, id_column: str, vector: str, k: int, p: int = 2, exclude_self: bool = False) -> DataFrame:
        """(qid, pid, payload, distance, place 1..k) for each row of ``queries``; ties go to the lower id.

        ``exclude_self`` leaves out the fitted row of the same id.
        """
        path = self.path
        id_type, payload_type = self.types
        names = ["qid", "pid", "payload", "distance", "place"]

        def nearer(held: tuple, block: _Block, own: np.ndarray, x: np.ndarray) -> tuple:
            """The k nearest of what is held and the block: (row of x, distance, id, payload), and the last distance of each row."""
            *so_far, last = held
            row, col = block.candidates(x, own if exclude_self else None, k, last)
            pairs = max(1, CELLS // max(1, x.shape[1]))
            dist = np.concatenate([np.empty(0), *(_exact(x[row[i : i + pairs]], block.points[col[i : i + pairs]], p) for i in range(0, len(row), pairs))])
            new = [row, dist, block.ids[col], block.payload[col]]
            row, dist, pid, payload = map(np.concatenate, zip(so_far, new)) if so_far else new
            order = np.lexsort((dist, row))  # ties stay in the order of the ids
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
            row, dist = row[order], dist[order]
            full = np.searchsorted(row, np.arange(len(x)) + 1) - 1  # the last one of each row
            count = np.bincount(row, minlength=len(x))
            return row, dist, pid[order], payload[order], np.where(count == k, dist[full] if len(dist) else np.inf, np.inf)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                asked, x = batch["qid"].to_numpy(), np.stack(batch["vec"].to_numpy()).astype(np.float64)
                step = max(1, CELLS // max(1, min(ROWS_OF_BLOCK, CELLS // max(1, x.shape[1]))))
                held = {at: (np.full(len(x[at : at + step]), np.inf),) for at in range(0, len(x), step)}
                with np.errstate(invalid="ignore", over="ignore"):
                    for fitted in _blocks(path, ROWS_OF_BLOCK, ROWS_READ, CELLS):
                        block = _Block(*fitted, p)
                        for at in held:
                            held[at] = nearer(held[at], block, asked[at : at + step], x[at : at + step])
                for at, (*found, _) in held.items():
                    if found:
                        row, dist, pid, payload = found
                        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
                        yield pd.DataFrame(dict(zip(names, (asked[at + row], pid, payload, dist, place.astype(np.int32)))))

        asking = queries.select(F.col(id_column).alias("qid"), F.col(vector).cast("array<double>").alias("vec"))
        tasks = TASKS_A_CORE * asking.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: one small file would be one task
        return asking.repartition(tasks, F.xxhash64("qid", "vec")).mapInPandas(ask, f"qid {asking.schema['qid'].dataType.simpleString()}, pid {id_type}, payload {payload_type}, distance double, place int")


def fit_neighbours(points: DataFrame, id_column: str, vector: str, payload: str, most: int | None = None) -> Neighbours:
    """All rows are fitted.  Only a caller who asks for ``most`` rows gets those with the smallest hash of their id."""
    rows = points.select(F.col(id_column).alias("i"), F.col(payload).alias("y"), F.col(vector).cast("array<double>").alias("v"))
    types = tuple(rows.schema[c].dataType.simpleString() for c in "iy")
    if most is not None:
        rows = rows.orderBy(F.xxhash64("i"), "i").limit(most)
    path = scratch_path(points.sparkSession, "fitted")
    rows.orderBy(F.col("i").asc_nulls_last(), "v").write.parquet(path)  # files are named in this order
    return Neighbours(path, types)


def nearest_neighbours(
    queries: DataFrame, points: DataFrame, id_column: str, vector: str, k: int, payload: str, p: int = 2,
    exclude_self: bool = False, most: int | None = None,
) -> DataFrame:
    """Fit ``points`` and ask ``queries``."""
    return fit_neighbours(points, id_column, vector, payload, most).nearest(queries, id_column, vector, k, p, exclude_self)


def knn_vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """Majority label per query; ``distance`` weights by 1/d (exact matches decide alone)."""
    if weights == "uniform":
        ballots = neighbours.groupBy("qid", "payload").agg(F.count(F.lit(1)).cast("double").alias("w"))
    else:
        exact = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy("qid"))
        weight = F.when(F.col("exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        ballots = neighbours.withColumn("exact", exact).groupBy("qid", "payload").agg(F.sum(weight).alias("w"))
    return ballots.groupBy("qid").agg(F.min_by("payload", F.struct(-F.col("w"), F.col("payload"))).alias("prediction"))
