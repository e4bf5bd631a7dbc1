"""Sharding by vector bin packing.

Rows with equal text form a group; a group's vector holds its bytes, words and rows, each as a share of the
total.  Groups are placed one after the other, the largest first, into the bin where the dot product of their
vector with what the bin has left is highest, so the bins fill up evenly in all three measures at once.

One list of all groups would be one task's work, so the packing goes up a tree: blocks of a few thousand groups
pack into small bins of their own; these bins are the items of the next level, until few enough remain to be
packed into the shards.  Groups that are large against a shard skip the lower levels and are placed singly at the
top, where the small bins even out what they leave.  A group larger than ``piece`` of a shard cannot stay whole
without spoiling the balance; its rows are dealt to pieces.

Law ``bytes``: sizes come near each other.  A null text has size 1 and the checksum of the empty text; an empty
table gives an empty result; ids may be null or repeated, every row gets a place of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import n_words, ship, text_or_empty

#: A group's vector, as shares of the table's totals.
DIMS = ("size", "words", "rows")


def best_bins(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each vector: largest first, where it meets the most free room; ties go to the lowest bin."""
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0.0)))
    total = vectors.sum(axis=0)
    total[total == 0] = 1.0
    free = np.ones((bins, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    scaled = vectors / total * bins
    for i in order:
        k = int(np.argmax(free @ scaled[i]))
        out[i] = k
        free[k] -= scaled[i]
    return out


def packed(items: DataFrame, bins: int) -> DataFrame:
    """``items`` (block, key, DIMS) -> (block, key, bin, DIMS), each block packed on its own."""

    def pack(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("key", ignore_index=True)
        one["bin"] = best_bins(one[list(DIMS)].to_numpy(float), bins)
        return one[["block", "key", "bin", *DIMS]]

    schema = "block long, key string, bin long, " + ", ".join(f"{d} double" for d in DIMS)
    return items.select("block", "key", *DIMS).groupBy("block").applyInPandas(pack, schema)


def pack_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, block_items: int = 2000, block_bins: int = 40, top_items: int = 4000, alone: float = 0.01, piece: float = 0.5
) -> DataFrame:
    """(id, size, words, text_crc32, shard, slot), a row for each row of ``df``.

    ``block_items`` groups go to a block on average and give ``block_bins`` items; the last level holds
    ``top_items`` of them and the groups above ``alone`` of a shard (``3 * shards / alone`` at most, as each takes
    that share of one of the three measures).
    """
    spark = df.sparkSession
    ship(spark)
    text = text_or_empty(text_col)
    # the row number is settled by being written: later passes read it, whatever happens to executors
    rows = store(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), n_words(F.col(text_col)).alias("words"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    totals = rows.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")).first()
    total = {d: max(1, totals[d] or 0) for d in DIMS}

    group = ["h", "text_crc32", "size"]
    sums = [F.sum("size").alias("sum_size"), F.sum("words").alias("sum_words"), F.count("*").alias("sum_rows")]
    share = F.greatest(*[F.col(f"sum_{d}") / F.lit(float(total[d])) for d in DIMS]) * shards
    # groups that have to be cut are fewer than 3 * shards / piece, whatever the data
    cut = rows.groupBy(*group).agg(*sums).where(share > piece).select(*group, F.ceil(share / (piece / 8)).cast("long").alias("pieces"))
    cut_rows = {(r.h, r.text_crc32, r["size"]): r.pieces for r in cut.collect()}
    part = F.lit(0).cast("long")
    for (h, crc, size), n in cut_rows.items():
        part = F.when((F.col("h") == h) & (F.col("text_crc32") == crc) & (F.col("size") == size), F.pmod(F.xxhash64("row"), F.lit(n))).otherwise(part)
    rows = rows.withColumn("key", F.concat_ws(":", *group, part))

    groups = rows.groupBy("key").agg(*sums).select("key", share.alias("share"), *[(F.col(f"sum_{d}") / F.lit(float(total[d]))).alias(d) for d in DIMS])
    n_rows = int(totals["rows"])
    levels: list[DataFrame] = []
    top = groups.where(F.col("share") > alone).select("key", *DIMS)
    items, n_items, level = groups.where(F.col("share") <= alone).select("key", *DIMS), n_rows, 0
    while n_items > top_items:
        blocks = -(-n_items // block_items)
        block = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks))
        done = store(packed(items.withColumn("block", block), block_bins).withColumn("up", F.concat_ws("/", F.lit(level), "block", "bin")), f"shard-level-{level}")
        levels.append(done.select("key", "up"))
        items = done.groupBy(F.col("up").alias("key")).agg(*[F.sum(d).alias(d) for d in DIMS])
        n_items, level = blocks * block_bins, level + 1
    last = store(packed(top.unionByName(items).withColumn("block", F.lit(0).cast("long")), shards), "shard-top")

    place = last.select("key", F.col("bin").cast("int").alias("shard"))
    for done in reversed(levels):
        below = done.join(place.withColumnRenamed("key", "up"), "up").select("key", "shard")
        place = below.unionByName(place)
    placed = rows.join(place, "key")

    # numbers without gaps: rows are counted in parts of a shard, and each part starts where the one before ends
    parts = max(1, n_rows // (shards * 20_000))
    spread = store(placed.select("doc_id", "size", "words", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")), "shard-placed")
    counted = spread.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    return (
        spread.withColumn("at", F.row_number().over(within))
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "words", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"))
    )

