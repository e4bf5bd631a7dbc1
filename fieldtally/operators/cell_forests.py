"""Random forests of classes grown on the cells of their bins, a few whole trees a task.

Trees look at rows by the bins of their features only, so rows of one cell (a combination of bins) go the same way.  A
bootstrap draws every row a Poisson number of times; the rows of one class in a cell together are drawn a Poisson number
of times whose mean is their count.  So a tree needs the count of each class in each cell and nothing else of the rows.
Its rules are those of Spark's forests: Gini impurity, a random choice of columns for each node, splits between bins (bins
that are categories go by their count of the second class), leaves of one prediction side by side put together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, store

#: Bins of a feature: a split is a set of them, in the bits of a number.
MOST_BINS = 64
MOST_CLASSES = 100
#: Most cells that a task holds, and cells times trees that it grows.
CELLS = 2_000_000
GROWN_IN_TASK = 1_000_000
#: Below this gain a split is rounding.
LEAST_GAIN = 1e-12


@dataclass
class Tree:
    """Nodes in the order of their levels; the right child stands behind the left one, a leaf has none (-1)."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    def shares(self, bins: np.ndarray) -> np.ndarray:
        """Share of each class in the leaf of each row of ``bins``."""
        node = np.zeros(len(bins), np.int64)
        moving = np.arange(len(bins))
        while len(moving):
            at = node[moving]
            inner = self.left[at] >= 0
            moving, at = moving[inner], at[inner]
            b = bins[moving, self.feature[at]].astype(np.uint64)
            node[moving] = self.left[at] + 1 - ((self.goes_left[at] >> b) & np.uint64(1)).astype(np.int64)
        leaf = self.counts[node]
        return leaf / leaf.sum(axis=1, keepdims=True)

    def importances(self, features: int) -> np.ndarray:
        """Gain times rows by feature, as shares; zeros for a tree that does not split."""
        inner = self.left >= 0
        found = np.bincount(self.feature[inner], (self.gain * self.counts.sum(axis=1))[inner], features)
        return found / found.sum() if found.sum() else found


def _best_splits(bins, weights, node, totals, chosen, categories) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bins that go left) of the best split of each node among its ``chosen`` columns; gain 0: none.

    ``node`` says for each cell which node it is in, in ascending order.
    """
    m = len(totals)
    size = totals.sum(axis=1)
    before = (totals**2).sum(axis=1) / size
    gain, feature, goes_left = np.zeros(m), np.zeros(m, np.int32), np.zeros(m, np.uint64)
    for column in chosen.T:
        b = bins[np.arange(len(node)), column[node]].astype(np.int64)
        key = node * MOST_BINS + b
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        held = np.add.reduceat(weights[order], first, axis=0)  # a row for each bin of each node that has cells
        at, b = np.divmod(key[first], MOST_BINS)
        if categories:
            order = np.lexsort((b, held[:, 1], at))
            held, b = held[order], b[order]
        begins = np.searchsorted(at, np.arange(m))
        left = np.cumsum(held, axis=0)
        left -= (left - held)[begins][at]
        bits = np.left_shift(np.uint64(1), b.astype(np.uint64))
        right = totals[at] - left
        n_left, n_right = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = ((left**2).sum(axis=1) / n_left + (right**2).sum(axis=1) / n_right - before[at]) / size[at]
        last = np.r_[at[1:] != at[:-1], True]  # nothing stays on the right
        score[last] = 0.0
        best = np.maximum.reduceat(score, begins)
        top = np.flatnonzero((score == best[at]) & (best > np.maximum(gain, LEAST_GAIN))[at])
        top = top[np.unique(at[top], return_index=True)[1]]
        if not len(top):
            continue
        won = at[top]
        gain[won], feature[won] = best[won], column[won]
        if categories:
            sums = np.cumsum(bits)  # bits of one node are different: their sum is their union, and differences come out right beyond 64 bits too
            goes_left[won] = sums[top] - (sums - bits)[begins[won]]
        else:  # up to the bin, also those that the node has no cells in
            goes_left[won] = (bits[top] - np.uint64(1)) | bits[top]
    return gain, feature, goes_left


def grow_tree(bins: np.ndarray, counts: np.ndarray, columns: int, depth: int, rng: np.random.Generator, rate: float, categories: bool) -> Tree:
    """A tree on a bootstrap of the cells ``bins``, whose rows have ``counts`` of each class; ``columns`` are looked at in a node."""
    drawn = rng.poisson(counts * rate).astype(float)
    some = drawn.sum(axis=1) > 0
    bins, weights = bins[some], drawn[some]
    width = bins.shape[1]
    if not len(bins):
        return Tree(np.zeros(1, np.int32), np.zeros(1, np.uint64), np.full(1, -1), np.zeros(1), np.ones((1, counts.shape[1])))
    node = np.zeros(len(bins), np.int64)  # of each cell, among the nodes of the level
    levels, totals = [], weights.sum(axis=0, keepdims=True)
    for level in range(depth + 1):
        m = len(totals)
        gain, feature, goes_left = np.zeros(m), np.zeros(m, np.int32), np.zeros(m, np.uint64)
        mixed = (totals > 0).sum(axis=1) > 1
        mixed &= np.bincount(node, minlength=m) > 1
        if level < depth and mixed.any():
            number = np.cumsum(mixed) - 1
            rows = mixed[node]
            bins, weights, node = bins[rows], weights[rows], number[node[rows]]
            chosen = np.argsort(rng.random((number[-1] + 1, width)), axis=1)[:, :columns].astype(np.int32)
            gain[mixed], feature[mixed], goes_left[mixed] = _best_splits(bins, weights, node, totals[mixed], chosen, categories)
        split = gain > 0
        levels.append((feature, goes_left, np.where(split, 2 * np.cumsum(split) - 2, -1), gain, totals))
        if not split.any():
            break
        rows = split[mixed][node]
        bins, weights, node = bins[rows], weights[rows], np.flatnonzero(mixed)[node[rows]]
        b = bins[np.arange(len(node)), feature[node]].astype(np.uint64)
        node = levels[-1][2][node] + 1 - ((goes_left[node] >> b) & np.uint64(1)).astype(np.int64)
        order = np.argsort(node, kind="stable")
        bins, weights, node = bins[order], weights[order], node[order]
        totals = np.add.reduceat(weights, np.searchsorted(node, np.arange(2 * split.sum())), axis=0)
    feature, goes_left, _, gain, totals = map(np.concatenate, zip(*levels))
    left, ahead = [], 0
    for _, _, to, _, _ in levels:
        ahead += len(to)
        left.append(np.where(to >= 0, to + ahead, -1))
    for i in range(len(left) - 2, -1, -1):  # leaves of one prediction side by side are one leaf, the deepest first
        inner = np.flatnonzero(left[i] >= 0)
        below = sum(len(x) for x in left[: i + 1])
        leaf = left[i + 1] < 0
        says = levels[i + 1][4].argmax(axis=1)
        child = left[i][inner] - below
        left[i][inner[leaf[child] & leaf[child + 1] & (says[child] == says[child + 1])]] = -1
    return Tree(feature, goes_left, np.concatenate(left), gain, totals)


def _kept(df: DataFrame, label: str) -> str:
    """The folder that ``df`` is stored in, for tasks to read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def _stored_cells(path: str, width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(keys, bins, counts) of the stored cells, a batch after the other."""
    system, folder = fs.FileSystem.from_uri(path)
    for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")):
        with system.open_input_file(name) as file, pq.ParquetFile(file) as found:
            for batch in found.iter_batches(batch_size=65_536, use_threads=False):
                if len(batch):
                    keys = batch.column("__cell").to_pylist()
                    counts = np.stack(batch.column("__counts").to_numpy(zero_copy_only=False)) if "__counts" in batch.schema.names else np.zeros((len(keys), 0))
                    yield keys, np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width), counts


@dataclass
class CellForest:
    """A forest that grows when it is asked, in the shape of a pipeline whose last stage is a forest.

    ``ahead`` gives the bins of the features, numbers in ``names``, from the lowest up.
    """

    cells: str
    ahead: Sequence[Transformer]
    names: Sequence[str]
    most: Sequence[int]
    classes: int
    trees: int
    depth: int
    columns: int
    rate: float
    seed: int
    categories: bool
    number: int  # of cells

    @property
    def stages(self) -> list[CellForest]:
        return [self]

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return self.trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return self.depth

    def _tasks(self, spark) -> list[range]:
        cores = spark.sparkContext.defaultParallelism
        size = max(1, min(-(-self.trees // (2 * cores)), GROWN_IN_TASK // max(1, self.number)))
        return [range(at, min(at + size, self.trees)) for at in range(0, self.trees, size)]

    def _grown(self) -> Callable[[range], Iterator[tuple[int, Tree]]]:
        """What grows the trees of a task, one after the other."""
        path, width, columns, depth, seed, rate, categories = self.cells, len(self.names), self.columns, self.depth, self.seed, self.rate, self.categories

        def grown(numbers: range) -> Iterator[tuple[int, Tree]]:
            bins, counts = map(np.concatenate, zip(*((b, n) for _, b, n in _stored_cells(path, width))))
            order = np.lexsort(bins.T)  # whatever the order of the files
            bins, counts = bins[order], counts[order]
            for i in numbers:
                yield i, grow_tree(bins, counts, columns, depth, np.random.default_rng([seed & 0xFFFFFFFF, i]), rate, categories)

        return grown

    def importances(self, spark) -> np.ndarray:
        """Sum over the trees of the shares that each feature has in a tree's gains."""
        grown, tasks, width = self._grown(), self._tasks(spark), len(self.names)

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for task in batch["id"]:
                    for i, tree in grown(tasks[task]):
                        yield pd.DataFrame({"tree": [i], "shares": [tree.importances(width)]})

        found = spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(shares, "tree int, shares array<double>").collect()
        return sum((np.array(r.shares) for r in sorted(found)), np.zeros(width))

    def votes(self, asked: DataFrame) -> DataFrame:
        """Sums over the trees of the shares of each class, for the cells ``asked`` (``__cell``)."""
        spark = asked.sparkSession
        path = _kept(asked.select("__cell").distinct(), "asked-cells")
        grown, tasks, width, classes = self._grown(), self._tasks(spark), len(self.names), self.classes

        def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for task in batch["id"]:
                    trees = [tree for _, tree in grown(tasks[task])]
                    for keys, bins, _ in _stored_cells(path, width):
                        shares = sum(tree.shares(bins) for tree in trees)
                        yield pd.DataFrame({"__cell": keys, **{f"__v{c}": shares[:, c] for c in range(classes)}})

        schema = ", ".join(["__cell binary", *(f"__v{c} double" for c in range(classes))])
        each = spark.range(0, len(tasks), 1, len(tasks)).mapInPandas(vote, schema)
        return each.groupBy("__cell").agg(F.array(*[F.sum(f"__v{c}") for c in range(classes)]).alias("__sums"))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction`` (sums over the trees), ``probability`` and ``prediction`` (first class with the largest share)."""
        keyed = with_cells(df, self.ahead, self.names, self.most)
        votes = store(self.votes(keyed), "cell-votes")
        # first class with the largest sum
        choice = (F.array_position("__sums", F.array_max("__sums")) - 1).cast("double")
        shares = F.transform("__sums", lambda s: s / self.trees)
        joined = keyed.join(votes, "__cell", "left")
        return joined.select(*df.columns, array_to_vector("__sums").alias("rawPrediction"), array_to_vector(shares).alias("probability"), choice.alias("prediction"))


def with_cells(df: DataFrame, ahead: Sequence[Transformer], names: Sequence[str], most: Sequence[int]) -> DataFrame:
    """``df`` with ``__cell``, a byte for each feature's bin; no number counts as the last bin, as it does in Spark's trees."""
    out = df
    for stage in ahead:
        out = stage.transform(out)
    one = [F.lpad(F.hex(F.least(F.col(c), F.lit(n - 1)).cast("long")), 2, "0") for c, n in zip(names, most)]
    return out.select(*df.columns, F.unhex(F.concat(*one)).alias("__cell"))


def forest_on_cells(
    train: DataFrame, forest: Estimator, ahead: Sequence[Transformer], names: Sequence[str], most: Sequence[int], categories: bool = False,
) -> CellForest | None:
    """``forest`` on the cells of ``train``; None if it asks for what cells cannot say, or there are too many of them."""
    label = forest.getLabelCol()
    plain = forest.getImpurity() == "gini" and forest.getBootstrap() and forest.getMinInstancesPerNode() == 1 and not forest.getMinInfoGain()
    plain = plain and not forest.getMinWeightFractionPerNode() and not forest.isDefined("thresholds") and not (forest.isDefined("weightCol") and forest.getWeightCol())
    columns = {"auto": math.ceil(math.sqrt(len(names))), "sqrt": math.ceil(math.sqrt(len(names))), "all": len(names)}.get(forest.getFeatureSubsetStrategy())
    if not plain or not columns or max(most) > MOST_BINS:
        return None
    y = F.col(label).cast("double")
    low, top, odd = train.agg(F.min(y), F.max(y), F.count_if(y.isNull() | F.isnan(y) | (y != F.floor(y)))).first()
    if low is None or odd or low < 0 or top >= MOST_CLASSES or (categories and top > 1):
        return None
    classes = max(2, int(top) + 1)
    counts = F.array(*[F.count_if(y == c).cast("double") for c in range(classes)])
    cells = _kept(with_cells(train, ahead, names, most).groupBy("__cell").agg(counts.alias("__counts")), "forest-cells")
    number = train.sparkSession.read.parquet(cells).count()
    if number > CELLS:
        return None
    return CellForest(
        cells, ahead, names, most, classes, forest.getNumTrees(), forest.getMaxDepth(), columns,
        forest.getSubsamplingRate(), forest.getSeed(), categories, number,
    )
