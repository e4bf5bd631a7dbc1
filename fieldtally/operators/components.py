"""Principal components of several groups of columns from one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Block:
    """Standardised directions of one group; the largest loading of each is positive."""

    columns: list[str]
    means: list[float]
    scales: list[float]  # zero for a constant column, which takes no part
    loadings: np.ndarray  # columns x components
    variances: list[float]  # of the components, largest first

    def scores(self, prefix: str) -> list[Column]:
        parts = [F.lit(0.0) if s == 0 else (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.means, self.scales)]
        out = []
        for i in range(self.loadings.shape[1]):
            total = F.lit(0.0)
            for part, w in zip(parts, self.loadings[:, i]):
                total = total + part * F.lit(float(w))
            out.append(total.alias(f"{prefix}_PC{i + 1}"))
        return out


def by_prefix(columns: Sequence[str], prefixes: Sequence[str]) -> dict[str, list[str]]:
    """Columns of each prefix; a column belongs to the longest prefix that fits."""
    out: dict[str, list[str]] = {p: [] for p in prefixes}
    for c in columns:
        fits = [p for p in prefixes if c.startswith(p)]
        if fits:
            out[max(fits, key=len)].append(c)
    return {p: cs for p, cs in out.items() if cs}


def fit_blocks(df: DataFrame, groups: Mapping[str, Sequence[str]], k: int) -> dict[str, Block]:
    """One aggregate row: means, spreads and the covariances inside each group (complete rows of the group only).

    The driver solves matrices as wide as a group; nothing is as long as the rows.
    """
    aggs = []
    for g, (_, columns) in enumerate(groups.items()):
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(f"`{c}`").isNotNull()
        x = [F.when(complete, F.col(f"`{c}`").cast("double")) for c in columns]
        aggs += [F.avg(v).alias(f"m{g}_{i}") for i, v in enumerate(x)]
        aggs += [F.covar_pop(x[i], x[j]).alias(f"c{g}_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*aggs).first()
    out = {}
    for g, (name, columns) in enumerate(groups.items()):
        d = len(columns)
        cov = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = row[f"c{g}_{i}_{j}"] or 0.0
        means = np.array([row[f"m{g}_{i}"] or 0.0 for i in range(d)])
        scales = np.sqrt(np.maximum(np.diag(cov), 0.0))
        scales[scales <= 1e-12 * np.abs(means)] = 0.0  # rounding of a constant
        safe = np.where(scales > 0, scales, 1.0)
        values, vectors = np.linalg.eigh(np.where(np.outer(scales, scales) > 0, cov, 0.0) / np.outer(safe, safe))
        order = np.argsort(-values, kind="stable")[:k]
        loadings = vectors[:, order]
        loadings = loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
        out[name] = Block(list(columns), means.tolist(), scales.tolist(), loadings, values[order].tolist())
    return out


def bind_scores(df: DataFrame, blocks: Mapping[str, Block], drop: bool = False) -> DataFrame:
    """The scores of every group beside the rows (``drop``: instead of the groups' columns)."""
    out = df.select("*", *[c for name, b in blocks.items() for c in b.scores(name)])
    return out.drop(*[c for b in blocks.values() for c in b.columns]) if drop else out
