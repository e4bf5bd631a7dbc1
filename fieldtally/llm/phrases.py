"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into the phrases a dictionary compressor would enter: each phrase is the shortest
string from here on that is not among the phrases yet.  Texts that compress well together share phrases, so
the likeness of two phrase sets says how much either text helps to compress the other.  A set is kept as its
smallest hashes; two such signatures estimate the share of common phrases.

``fingerprints`` gives each document its fingerprint, that of an edited text (its second half replaced by the
beginning of the next document in ascending id order) and the likeness to both.  The first half is parsed once
for both texts.  Documents come in blocks of neighbouring ids; the first document of a block is also sent to
the block before it, so every neighbour is in place after one shuffle, of compressed texts.

Null text counts as empty; two empty texts are alike (1).  Null ids come last.  Rows with equal ids are
ordered by a hash of their text; equal rows are neighbours of each other.  An empty table gives no rows, a single
document is its own neighbour.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_bounds, block_of, order_key, ship, text_or_empty

HASHES = 64


def parse(data: bytes, seen: set[bytes], i: int = 0) -> int:
    """Adds the phrases of ``data`` from ``i`` on; returns where the phrase begins that the end cuts short.

    ``seen`` holds the beginnings of all it holds, so the search can start from a guess and go either way.
    """
    n, size, add = len(data), 3, seen.add
    while i < n:
        if data[i : i + size] in seen:
            size += 1
            while i + size <= n and data[i : i + size] in seen:
                size += 1
            if i + size > n:
                if data[i:] in seen:
                    return i
                size = n - i
        else:
            while size > 1 and data[i : i + size - 1] not in seen:
                size -= 1
        add(data[i : i + size])
        i += size
    return n


def signature(seen: set[bytes]) -> np.ndarray:
    """The smallest hashes, ascending."""
    h = np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen))
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)  # wraps round
    h ^= h >> np.uint64(31)
    h = np.unique((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(32))
    return h[:HASHES].astype(np.uint32)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common phrases among the smallest hashes of both sets together; exact for small sets."""
    mine, yours = set(a.tolist()), set(b.tolist())
    both = sorted(mine | yours)[:HASHES]
    if not both:
        return 1.0
    return len((mine & yours).intersection(both)) / len(both)


def edited(text: str, following: str) -> tuple[str, str]:
    """(what stays of the text, what replaces its second half)."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


def fingerprint(text: str) -> np.ndarray:
    seen: set[bytes] = set()
    parse(text.encode("utf-8", "replace"), seen)
    return signature(seen)


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Of a text and of its edited text, and the checksum of the latter; the common beginning is parsed once."""
    head, tail = edited(text, following)
    start, own, other = head.encode("utf-8", "replace"), text[len(head) :].encode("utf-8", "replace"), tail.encode("utf-8", "replace")
    seen: set[bytes] = set()
    at = parse(start, seen)
    changed = seen.copy()
    parse(start[at:] + other, changed)
    parse(start[at:] + own, seen)
    return signature(seen), signature(changed), hashlib.sha256(start + other).hexdigest()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 2000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(order_key(F.col("doc_id"), F.xxhash64("text")), ("k0", "k1", "k2"))])
    bounds = block_bounds(docs.select("k0", "k1", "k2"), rows_per_block)
    given = spark.sparkContext.broadcast(bounds)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, packer = given.value, zstandard.ZstdCompressor(level=3)
        starts = {k: i for i, k in enumerate(bounds)}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                key, packed = tuple(key), packer.compress(text.encode("utf-8", "replace"))
                rows.append((block_of(bounds, key), 0, *key, doc_id, packed))
                at = starts.get(key)
                if at is not None:  # also the follower of the block before, the first of all that of the last
                    rows.append(((at or len(bounds)) - 1, 1, *key, doc_id, packed))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["block", "tail", "k0", "k1", "k2", "doc_id", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before: tuple | None = None  # (block, id, text) that waits for its neighbour
        half_done: tuple | None = None  # the row before that one, which waits for the neighbour's fingerprint
        for batch in batches:
            out: list[tuple] = []
            for block, tail, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 5, 6))):
                here = before is not None and before[0] == block
                if tail and not here:
                    continue  # equal rows begin the next block: one of them is enough
                text = unpacker.decompress(packed).decode("utf-8")
                if here:
                    mine, changed, digest = both_fingerprints(before[2], text)
                    if half_done is not None:
                        out.append((*half_done[0], likeness(half_done[1], mine)))
                    half_done = ((before[1], len(before[2]), digest, as_text(mine), as_text(changed), likeness(mine, changed)), mine)
                    if tail:
                        out.append((*half_done[0], likeness(half_done[1], fingerprint(text))))
                        half_done = None
                before = None if tail else (block, doc_id, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=names)

    moved = docs.mapInArrow(spread, "block long, tail long, k0 long, k1 long, k2 long, doc_id long, packed binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_blocks = moved.repartition(parts, "block").sortWithinPartitions("block", "tail", "k0", "k1", "k2")
    return sorted_blocks.mapInArrow(
        compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
