"""Merkle manifest of a table: a root over all rows, and a proof for each row.

A leaf is the checksum of a row's columns, each with its length, so no two rows share one by moving bytes from
column to column.  The leaves of a group (a source) stand in ascending order of their ids; three neighbours make
a node, the last ones of a level may be fewer, and the roots of all groups are the leaves of one more tree.

The leaves are numbered by a range partitioning, and cut into aligned blocks of 3**HEIGHT leaves.  A block's subtree is
one stored row: its digests lie in van Emde Boas order, where a tree is cut at half its height, the top part comes
first and every bottom part follows in one piece, each laid out in the same way.  A node's address follows from its
level and number by a few table entries; building and looking up siblings both use these addresses, and any stretch of
memory of a given size serves as many levels of a path as it can.  Block roots are the leaves of the next
table, until every group has one; the group roots go through the same once more.  A proof takes the siblings from the row's
block, then from the block above, and so on; no task holds more than one block and its rows, and joins fan out to one
block's width at most, however large a group is.

Ids that are missing come first, rows of one id by their leaf; equal rows have neighbouring places and each its own proof.
Missing columns count as ``-``; a missing group comes first.  An empty table has no rows, no blocks and no root.
Texts pass through Spark's own checksum whole, and are read once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import ship

FAN = 3
HEIGHT = 6
WIDTH = FAN**HEIGHT
SIZE = 32


@lru_cache(maxsize=None)
def splits(height: int) -> tuple[list[int], list[int], list[int]]:
    """Per depth below the root: depth of the enclosing cut's top root, nodes of its top part, of one bottom part."""
    above, top, bottom = [0] * (height + 1), [0] * (height + 1), [0] * (height + 1)
    count = lambda levels: (FAN**levels - 1) // (FAN - 1)

    def cut(root: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        lower = levels - upper
        above[root + upper], top[root + upper], bottom[root + upper] = root, count(upper), count(lower)
        cut(root, upper)
        cut(root + upper, lower)

    cut(0, height + 1)
    return above, top, bottom


def addresses(height: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes with these numbers at one depth of a tree."""
    above, top, bottom = splits(height)
    if depth == 0:
        return np.zeros_like(number)
    span = FAN ** (depth - above[depth])
    return addresses(height, above[depth], number // span) + top[depth] + number % span * bottom[depth]


@lru_cache(maxsize=None)
def level_addresses(height: int, level: int) -> list[int]:
    """Places of all nodes ``level`` levels above the leaves."""
    return addresses(height, height - level, np.arange(FAN ** (height - level))).tolist()


def height_of(n: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def subtree(leaves: list[bytes], height: int) -> bytes:
    """A block's digests in van Emde Boas order; places without a node are zero."""
    nodes = bytearray(SIZE * ((FAN ** (height + 1) - 1) // (FAN - 1)))
    row = leaves
    for level in range(height + 1):
        for at, digest in zip(level_addresses(height, level), row):
            nodes[at * SIZE : (at + 1) * SIZE] = digest
        if level < height:
            row = [parent(row[i : i + FAN]) for i in range(0, len(row), FAN)]
    return bytes(nodes)


def siblings(nodes: bytes, height: int, n: int, number: int) -> tuple[list[bytes], bytes]:
    """(siblings of a leaf's path, level by level and left to right; own place in each run, four to the byte's rest)."""
    out, shape = [], bytearray()
    for level in range(height):
        at = level_addresses(height, level)
        first = number - number % FAN
        run = min(FAN, n - first)
        out += [nodes[at[i] * SIZE : (at[i] + 1) * SIZE] for i in range(first, first + run) if i != number]
        shape.append((number - first) * 4 + run)
        number, n = number // FAN, -(-n // FAN)
    return out, bytes(shape)


def folded(leaf: bytes, proof: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for step in shape:
        place, run = divmod(step, 4)
        others = [proof[at + SIZE * i : at + SIZE * (i + 1)] for i in range(run - 1)]
        at += SIZE * (run - 1)
        leaf = parent([*others[:place], leaf, *others[place:]])
    return leaf


def leaf_of(columns: list[Column]) -> Column:
    """Checksum of a row: of each column ``-`` or its length in UTF-8 bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def numbered(df: DataFrame, group: str, order: list[str], rows_per_task: int = 200_000) -> DataFrame:
    """Adds ``pos`` (from 0, inside the group by ``order``) and ``n`` (rows of the group) to stored rows.

    Rows are dealt by ranges of (group, order), so one group may lie in many tasks; the driver sees nothing but the
    number of rows.  ``order`` must tell rows apart, or their order does not matter.
    """
    parts = max(1, -(-df.count() // rows_per_task))
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the number that Spark gives a row: its partition, and its place there
    dealt = store(dealt.withColumn("_id", F.monotonically_increasing_id()), "merkle-ordered")
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    counts = dealt.groupBy(group, "_part").agg(F.min("_id").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    before = F.sum("rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return dealt.join(starts, same).withColumn("pos", F.col("_id") - F.col("first") + F.col("before")).drop("_id", "_part", "_g", "_p", "first", "before")


BLOCK = "g string, block long, n long, height int, top binary, nodes binary"


def blocks_of(leaves: DataFrame) -> DataFrame:
    """(g, pos, n, digest) -> one stored row a block: its subtree in van Emde Boas order, and its root."""
    ship(leaves.sparkSession)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows.column("n")[0].as_py()
        height = HEIGHT if n > WIDTH else height_of(n)
        nodes = subtree(rows.column("digest").to_pylist(), height)
        values = [[key[0].as_py()], [key[1].as_py()], [n], [height], [nodes[:SIZE]], [nodes]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["g", "block", "n", "height", "top", "nodes"])

    cut = leaves.select("g", F.floor(F.col("pos") / WIDTH).alias("block"), "pos", "n", "digest")
    return store(cut.groupBy("g", "block").applyInArrow(build, BLOCK), "merkle-blocks")


@dataclass
class Manifest:
    """Stored block tables from the leaves up, for the groups and for the tree of their roots."""

    leaves: DataFrame  # g, pos, n, digest, and the columns that came along
    levels: list[DataFrame]
    groups: DataFrame  # g, subroot, pos, n, digest: the leaves of the upper tree
    upper: list[DataFrame]


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Block tables, until every group has one block."""
    levels = [blocks_of(leaves)]
    while not levels[-1].where(F.col("block") > 0).isEmpty():
        below = levels[-1]
        levels.append(blocks_of(below.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"), F.col("top").alias("digest"))))
    return levels


def manifest(rows: DataFrame) -> Manifest:
    """Build it for ``rows`` of (g, id, leaf) and any columns whose names differ from g, pos, n, digest."""
    placed = numbered(store(rows, "merkle-leaves"), "g", ["id", "leaf"]).withColumn("digest", F.col("leaf"))
    leaves = store(placed, "merkle-numbered")
    levels = grown(leaves)
    # a group's only block in the last table has its root; Spark orders strings by their UTF-8 bytes
    roots = store(levels[-1].select(F.lit("").alias("all"), F.col("g").alias("source"), F.col("top").alias("subroot")), "merkle-subroots")
    groups = store(numbered(roots, "all", ["source"]).select(F.col("source").alias("g"), "subroot", "pos", "n", F.col("subroot").alias("digest")), "merkle-groups")
    return Manifest(leaves, levels, groups, grown(groups.select(F.lit("").alias("g"), "pos", "n", "digest")))


def looked_up(rows: DataFrame, blocks: DataFrame, keep: str) -> DataFrame:
    """Adds ``proof`` and ``shape`` to rows (g, pos, n, ``keep`` columns): siblings in their block, then what the block has
    (its columns ``up_proof``, ``up_shape``, ``root``)."""
    ship(rows.sparkSession)
    names = [c.split()[0] for c in keep.split(", ")]

    def retrieve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([left.column(c) for c in names] + [pa.array([], pa.binary())] * 3, names=[*names, "proof", "shape", "root"])
        nodes, height, up_proof, up_shape, root = (right.column(c)[0].as_py() for c in ("nodes", "height", "up_proof", "up_shape", "root"))
        start = key[1].as_py() * WIDTH
        n = min(WIDTH, left.column("n")[0].as_py() - start)
        found = [siblings(nodes, height, n, p - start) for p in left.column("pos").to_pylist()]
        proofs = pa.array([b"".join(s) + up_proof for s, _ in found], pa.binary())
        shapes = pa.array([s + up_shape for _, s in found], pa.binary())
        return pa.Table.from_arrays([*(left.column(c) for c in names), proofs, shapes, pa.array([root] * len(found), pa.binary())], names=[*names, "proof", "shape", "root"])

    cut = rows.select(F.floor(F.col("pos") / WIDTH).alias("block"), F.col("g").alias("gg"), "pos", "n", *names)
    right = blocks.select(F.col("g").alias("gg"), "block", "nodes", "height", "up_proof", "up_shape", "root")
    paired = cut.groupBy("gg", "block").cogroup(right.groupBy("gg", "block"))
    return paired.applyInArrow(retrieve, f"{keep}, proof binary, shape binary, root binary")


def above(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest block table with what stands above each block; ``tops``: g, up_proof, up_shape, root of the highest."""
    with_up = levels[-1].join(tops, F.col("g").eqNullSafe(F.col("tg"))).drop("tg")
    for below in reversed(levels[:-1]):
        rows = below.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / WIDTH).alias("n"), F.col("g").alias("og"), F.col("block").alias("ob"))
        ups = store(looked_up(rows, with_up, "og string, ob long"), "merkle-up")
        ups = ups.select("og", "ob", F.col("proof").alias("up_proof"), F.col("shape").alias("up_shape"), "root")
        with_up = below.join(ups, F.col("g").eqNullSafe(F.col("og")) & (F.col("block") == F.col("ob"))).drop("og", "ob")
    return with_up


def proofs(m: Manifest, keep: str) -> DataFrame:
    """The leaves' columns named in ``keep`` ("name type, ..."), with subroot, proof, shape (own place and width of every run) and root."""
    empty = F.lit(b"")
    top_of_all = m.upper[-1].select(F.col("g").alias("tg"), empty.alias("up_proof"), empty.alias("up_shape"), F.col("top").alias("root"))
    sources = store(looked_up(m.groups.select(F.lit("").alias("g"), F.col("g").alias("source"), "pos", "n", "subroot"), above(m.upper, top_of_all), "source string, subroot binary"), "merkle-sources")
    tops = sources.select(F.col("source").alias("tg"), F.col("proof").alias("up_proof"), F.col("shape").alias("up_shape"), F.struct("subroot", "root").alias("both"))
    # both roots travel as one value
    packed = tops.select("tg", "up_proof", "up_shape", F.concat("both.subroot", "both.root").alias("root"))
    found = looked_up(m.leaves, above(m.levels, packed), keep)
    names = [c.split()[0] for c in keep.split(", ")]
    return found.select(*names, "proof", "shape", F.substring("root", 1, SIZE).alias("subroot"), F.substring("root", SIZE + 1, SIZE).alias("root"))


def checked(found: DataFrame, leaf: str, out: str = "folded") -> DataFrame:
    """Adds ``out``: the root that the digests of column ``leaf`` lead to over each row's proof."""
    ship(found.sparkSession)

    @F.arrow_udf("binary")
    def fold(leaves: pa.Array, paths: pa.Array, shapes: pa.Array) -> pa.Array:
        return pa.array([folded(*row) for row in zip(leaves.to_pylist(), paths.to_pylist(), shapes.to_pylist())], pa.binary())

    return found.withColumn(out, fold(F.col(leaf), F.col("proof"), F.col("shape")))


def document_manifest(docs: DataFrame) -> tuple[Manifest, DataFrame]:
    """(the manifest, a row per document): doc_id, leaf, proof, shape, subroot, root, and ``changed``, the leaf of the
    document without its line ends where the checksum of its id is even, else the leaf itself."""
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & (F.instr("text", "\n") > 0), leaf_of([*named[:4], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])).otherwise(F.col("leaf"))
    rows = docs.select(*named).withColumn("leaf", leaf_of(named)).select(F.col("source").alias("g"), F.col("doc_id").cast("long").alias("id"), "leaf", changed.alias("changed"))
    m = manifest(rows)
    return m, proofs(m, "id long, leaf binary, changed binary")
