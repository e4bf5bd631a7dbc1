"""Exact top-k inner products by a vector-approximation file.

Every vector is also kept as one byte a dimension: the cell of a grid that its component lies in.  A scan over these
cells gives each query a lower and an upper bound of its score with every vector.  A vector whose upper bound
is below the k-th best lower bound is out.  The others are read exactly, highest upper bounds first (a score's highest
bound is a distance's lowest), until no unread vector's bound reaches the k-th best score found, ties included.  The result is
exact whatever the grid; its cells are cut at quantiles of a bounded sample (``sample`` vectors, the smallest
hashes), the outer ones reach to the least and greatest value of all.

Equal vectors are one node: of its rows only the k + 1 with the smallest ids can be in a result, and a query whose vector
many rows share is asked once.  Nodes are dealt into blocks, queries too, and each pair of blocks is one group of bounded
size.  A null vector, or one with a null or non-finite component, takes no part.  A row without an id is no query, but
a candidate after all ids of its score.  Rows of one id are told apart: only the query's own row is left out.
Vectors of different widths count as padded with zeros.  Scores that no 64-bit number holds end at its limits.  An
empty table has no rows in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import ship

LIMIT = 1 << 63


def scaled(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component; null if any is null or not finite."""
    x = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    return F.when(fine, F.transform(vector, lambda v: F.floor(F.lit(factor) * x(v)).cast("long")))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists as rows of one width, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def dots(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Exact inner products of rows, two by two."""
    if not a.size:
        return [0] * len(a)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b).tolist()
    exact = ((sum(int(x) * int(y) for x, y in zip(p, q))) for p, q in zip(a, b))
    return [max(-LIMIT, min(LIMIT - 1, s)) for s in exact]


class Grid:
    """Cell borders of every dimension: row d has cells + 1 of them."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int):
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower") if len(sample) else np.zeros((cells - 1, len(low)))
        self.inner = inner.T.copy()
        self.low = np.concatenate((low[:, None], self.inner), axis=1).astype(float)
        self.high = np.concatenate((self.inner, high[:, None]), axis=1).astype(float)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Cell numbers: cell c holds values from border c (included) to border c + 1 (a value on a border is in the later cell)."""
        out = np.empty(vectors.shape, np.uint8)
        for d in range(vectors.shape[1]):
            out[:, d] = np.searchsorted(self.inner[d], vectors[:, d], side="right")
        return out

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the inner products, a row per query."""
        dims = np.arange(codes.shape[1])
        low, high = self.low[dims, codes], self.high[dims, codes]
        plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        slack = 1e-12 * (np.abs(queries.astype(float)) @ np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1, initial=0.0))[:, None]
        least, most = plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack
        return least.clip(-float(LIMIT), float(LIMIT)), most.clip(-float(LIMIT), float(LIMIT))  # as scores are


TILE = 128  # queries whose bounds are held at once


def candidates(queries: DataFrame, codes: DataFrame, grid, dims: int, k: int) -> DataFrame:
    """(q, node, low, high) of a pair of blocks: what the block's own k-th best lower bound leaves."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["q", "node", "low", "high"], [pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        wanted = matrix(left.column("vec"), dims)
        cells = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, dims)
        whose, whom, lows, highs = [], [], [], []
        for at in range(0, len(wanted), TILE):
            low, high = grid.value.bounds(wanted[at : at + TILE], cells)
            least = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if low.shape[1] > k else np.full(len(low), -np.inf)
            r, c = np.nonzero(high >= least[:, None])
            whose.append(r + at)
            whom.append(c)
            lows.append(low[r, c])
            highs.append(high[r, c])
        q, n = (pa.array(np.concatenate(x)) for x in (whose, whom))
        return pa.Table.from_arrays([left.column("node").take(q), right.column("node").take(n), pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs))], names=names)

    pairs = queries.groupBy("block", "qblock").cogroup(codes.groupBy("block", "qblock"))
    return pairs.applyInArrow(scan, "q binary, node binary, low double, high double")


def read_exactly(pairs: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """(q, node) with the exact score of the two vectors."""

    def score(batches):
        for batch in batches:
            values = dots(matrix(batch.column(2), dims), matrix(batch.column(3), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["q", "node", "score"])

    vectors = nodes.select("node", "vec")
    both = pairs.select("q", "node").join(vectors.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q").join(vectors, "node")
    return store(both.select("q", "node", "qvec", "vec").mapInArrow(score, "q binary, node binary, score long"), "vafile-scores")


def kth_best(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """(q, the (k + 1)-th largest value of a query; none if it has fewer).  One more than k: the query may meet itself."""
    best = Window.partitionBy("q").orderBy(F.col(value).desc())
    ranked = df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    return ranked.groupBy("q").agg(F.max(F.when(F.col("place") == k + 1, F.col(value))).alias(out))


def top_k(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, cells: int = 64, sample: int = 4096, block_rows: int = 16_384, query_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows where ``queries`` holds, against all rows but their own."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), scaled(F.col(vec_col)).alias("vec")).where("vec is not null")
    rows = store(rows.withColumn("node", F.unhex(F.md5(F.col("vec").cast("string")))), "vafile-rows")
    smallest = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_last())
    first = rows.select("node", "id", "vec").withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    # an array keeps missing ids inside a struct
    nodes = first.groupBy("node").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))
    nodes = store(nodes, "vafile-nodes")
    asked = rows.where("asks and id is not null").select("node", "id")
    shape = nodes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not shape.n or asked.isEmpty():
        return spark.createDataFrame([], result)
    dims = shape.dims
    # bounds of the padded vectors, a row a task at most; the sample is bounded by its rows
    extremes = nodes.select("vec").mapInArrow(edges(dims), "low array<long>, high array<long>").agg(
        F.array(*[F.min(F.col("low")[d]) for d in range(dims)]).alias("low"), F.array(*[F.max(F.col("high")[d]) for d in range(dims)]).alias("high")
    ).first()
    picked = nodes.select("vec", "node").orderBy(F.xxhash64("node"), "node").limit(sample).select("vec").toArrow()
    grid = spark.sparkContext.broadcast(Grid(matrix(picked.column("vec"), dims), np.array(extremes.low, float), np.array(extremes.high, float), cells))

    n_blocks = max(1, -(-shape.n // block_rows))
    asks = store(asked.select("node").distinct().join(nodes.select("node", "vec"), "node"), "vafile-asks")
    n_asks = max(1, -(-asks.count() // query_rows))

    def code(batches):
        for batch in batches:
            found = grid.value.codes(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in found], pa.binary())], names=["node", "codes"])

    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(n)).cast("int")
    file = store(nodes.select("node", "vec").mapInArrow(code, "node binary, codes binary").withColumn("block", dealt(n_blocks, 1)), "vafile-cells")
    left = asks.withColumn("qblock", dealt(n_asks, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = file.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    found = store(candidates(left, right, grid, dims, k), "vafile-candidates")

    least = kth_best(found, "low", k, "least")
    open_ones = store(found.join(least, "q").where(F.coalesce(F.col("high") >= F.col("least"), F.lit(True))).select("q", "node", "high"), "vafile-open")
    order = Window.partitionBy("q").orderBy(F.col("high").desc(), "node")
    first_read = open_ones.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * (k + 1))
    scores = read_exactly(first_read, nodes, dims)
    # what is unread and may still reach the k-th best; with fewer than k + 1 read there is nothing unread
    certain = kth_best(scores, "score", k, "kth")
    rest = open_ones.join(certain, "q").where(F.col("high") >= F.col("kth")).join(scores.select("q", "node"), ["q", "node"], "left_anti")
    scores = scores.unionByName(read_exactly(rest, nodes, dims))

    # of a query's vectors the k + 1 best rows, then each query row without itself
    met = scores.join(nodes.select("node", "ids"), "node").select("q", "node", "score", F.explode("ids").alias("i"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("i.none"), F.col("i.id"))
    lists = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = lists.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "score", F.col("i.id").alias("id"), (F.col("node") == F.col("q")).alias("own")))).alias("list"))
    answers = asked.join(lists.withColumnRenamed("q", "node"), "node")
    own = F.array_min(F.transform(F.filter("list", lambda x: x.own & x.id.eqNullSafe(F.col("id"))), lambda x: x.place))
    others = F.slice(F.filter("list", lambda x: own.isNull() | (x.place != own)), 1, k)
    return answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score")
    )


def edges(dims: int):
    def of(batches):
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                values = matrix(batch.column(0), dims)
                low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])

    return of
