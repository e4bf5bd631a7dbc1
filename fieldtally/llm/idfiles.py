"""Token ids in binary files: one zstandard dictionary for all, one frame to a document, an index in front.

Documents short enough to be read one by one are too short to compress well one by one; a dictionary trained on
serialized id arrays gives each frame what the documents have in common.  File format, little-endian:

    8 bytes   FTIDS001
    32 bytes  SHA-256 of the dictionary that the frames need (file ``dictionary.zstd`` beside)
    8 bytes   number of documents
    16 bytes a document: id (signed), the two highest bits of the next field being flags: frame's end within
              the data part (62 bits), null id (1 bit), one unused
    data      the frames: ids as unsigned 16-bit integers if the vocabulary fits, else 32-bit

A file ends with its block, or earlier when it holds ``file_bytes``.  Files hold neighbouring ids in ascending order (null ids last; rows with equal ids by a hash of their text), so the
files in order are the corpus in order.  A document is read by its two index entries and one frame.

The dictionary is trained on a piece from anywhere of each document of a bounded sample by hash (``sample`` documents
at most, a parameter); every document is encoded whole.  A file is written under a name of its own and then moved to its
final name, so a task that runs twice leaves one whole file; the manifest names the files that count.
Null text is empty: its frame holds the end id alone.  An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, store
from .bpe import chunks, gathered
from .common import block_bounds, block_of, order_key, ship, text_or_empty

MAGIC = b"FTIDS001"
_NULL = 1 << 62
BLOCKS_PER_TASK = 8  # at most, on average: tasks grow in number with the table


class CachedTokenizer:
    """The tokenizer library on pieces it has not met lately; pieces end where its own splitting ends them.

    A piece stands for itself with a space in front, one that begins with a space for what follows that space.
    The ids of the pieces lie in one table; a text is put together from it by the numbers of its pieces.
    """

    KEPT, LONGEST = 1_200_000, 48
    RUN = 1 << 22  # characters that are worked on at once (a longer text alone)
    JOINED = 1024  # pieces that the library is given as one text

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.keep([], [])
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character of a token is a byte
            self.n_bytes[i] = len(token)

    def keep(self, pieces: list[str], ids: list[np.ndarray]) -> None:
        """These pieces are known, no others."""
        self.known: dict[str, int] = dict(zip(pieces, range(len(pieces))))  # their places in begins and sizes
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.table = np.concatenate([np.empty(0, self.kind), *ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, serialized as ``kind``."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        which, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        firsts = [" " + pieces[i] for i in which[edges[:-1]].tolist()]
        place = self.places(pieces)
        # a space beside other white space ends no piece: such texts are cut at their other spaces only
        odd = np.zeros(len(pieces), bool)
        odd[[i for i in np.flatnonzero(place < 0).tolist() if not (p := pieces[i]) or p[0].isspace() or p[-1].isspace()]] = True
        more: list[str] = []
        if odd.any():
            others: dict[str, int] = {}
            parts = np.split(which, edges[1:-1])
            for i in np.unique(np.searchsorted(edges, np.flatnonzero(odd[which]), "right") - 1).tolist():
                first, *rest = chunks(texts[i])
                firsts[i] = " " + first
                parts[i] = np.array([0, *(len(pieces) + others.setdefault(p, len(others)) for p in rest)], np.int64)
            which, edges = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            more += others
        begun = {p: len(pieces) + len(more) + i for i, p in enumerate(dict.fromkeys(firsts))}
        which[edges[:-1]] = [begun[p] for p in firsts]
        more += begun
        pieces, place = pieces + more, np.concatenate((place, self.places(more)))
        begins, sizes, table = self.found(pieces, place, np.bincount(which, minlength=len(pieces)) > 0)
        lengths = sizes[which]
        ids = gathered(table, begins[which], lengths)
        ends = np.concatenate(([0], np.cumsum(lengths)))[edges].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def found(self, pieces: list[str], place: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece that is used begin in the table, how many they are, and the table."""
        new = np.flatnonzero((place < 0) & used)
        if not len(new):
            return self.begins[place], self.sizes[place], self.table
        if len(self.known) + len(new) > self.KEPT:  # frequent pieces are soon met again: those at hand stay
            old = np.flatnonzero(place >= 0)
            at, n = self.begins[place[old]].tolist(), self.sizes[place[old]].tolist()
            self.keep([pieces[i] for i in old.tolist()], [self.table[b : b + k] for b, k in zip(at, n)])
            place[old] = self.places([pieces[i] for i in old.tolist()])
        learnt, ids, cuts, kept = self.learn([pieces[i] for i in new.tolist()])
        number = dict(zip(learnt, range(len(self.sizes), len(self.sizes) + len(learnt))))
        place[new] = [number[pieces[i]] for i in new.tolist()]
        sizes = np.diff(cuts, prepend=0)
        begins, sizes = np.concatenate((self.begins, len(self.table) + cuts - sizes)), np.concatenate((self.sizes, sizes))
        table = np.concatenate((self.table, ids))
        if len(self.known) + kept > self.KEPT:
            self.keep([], [])
        elif kept:
            n = len(self.sizes) + kept
            self.known.update(zip(learnt[:kept], range(n - kept, n)))
            self.begins, self.sizes, self.table = begins[:n], sizes[:n], table[: begins[n - 1] + sizes[n - 1]]
        return begins[place], sizes[place], table

    def learn(self, unknown: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, int]:
        """The unknown pieces in a new order, their ids one after the other, where each piece's ids end, and how many of these pieces are to be remembered (the first ones).

        Those that end where the next one's space begins are encoded side by side.
        """
        order: list[str] = []
        parts, cuts, done = [np.empty(0, self.kind)], [np.empty(0, np.int64)], 0
        alone, unlike = [], []  # the last ones are not remembered: one that ends with white space is a piece at the end of a text only
        joined = []
        for p in unknown:
            if not p or len(p) > self.LONGEST or p[-1].isspace():
                unlike.append(p)
            else:
                (alone if " " in p else joined).append(p)
        for at in range(0, len(joined), self.JOINED):
            some = joined[at : at + self.JOINED]
            text = " " + " ".join(some)
            (told,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(told.ids, self.kind)
            raw = text.encode()
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
            reached = np.cumsum(self.n_bytes[ids])
            mine = np.searchsorted(reached, ends) + 1
            if mine[-1] != len(ids) or not np.array_equal(reached[mine - 1], ends):  # a token that goes over a seam
                alone += some
                continue
            order += some
            parts.append(ids)
            cuts.append(mine + done)
            done += len(ids)
        kept = len(order) + len(alone)
        alone += unlike
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            told = self.tokenizer.encode_batch_fast([p[1:] if p[:1] == " " else " " + p for p in some], add_special_tokens=False)
            order += some
            each = [np.array(e.ids, self.kind) for e in told]
            parts += each
            cuts.append(np.cumsum([len(x) for x in each]) + done)
            done += sum(map(len, each))
        return order, np.concatenate(parts), np.concatenate(cuts), kept

    def runs(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Consecutive texts of about ``RUN`` characters together: first, behind the last."""
        lo = size = 0
        for hi, text in enumerate(texts):
            if hi > lo and size + len(text) > self.RUN:
                yield lo, hi
                lo, size = hi, 0
            size += len(text)
        if lo < len(texts):
            yield lo, len(texts)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive batches of at most ``most`` bytes as one table; a larger batch alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary; too little to train on gives a raw-content one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_ids(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    rows_per_file: int = 4000, file_bytes: int = 64 << 20, sample: int = 1000, sample_bytes: int = 2000, dictionary_bytes: int = 110_000, level: int = 3,
) -> DataFrame:
    """Writes the files below ``path`` and returns their manifest: (block, part, file, n_docs, n_ids), a row per file."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(order_key(F.col("doc_id"), F.xxhash64("text")), ("k0", "k1", "k2"))])
    keys = store(docs.select("k0", "k1", "k2"), "id-keys")  # asked several times; the texts behind them are read once for all
    bounds = block_bounds(keys, rows_per_file)
    dictionary = train_on(docs, keys, tokenizer_path, end_id, sample, sample_bytes, dictionary_bytes)
    given = spark.sparkContext.broadcast((bounds, dictionary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, dictionary = given.value
        one = tokenizer(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        end = np.array([end_id], one.kind).tobytes()
        for table in together(batches, one.RUN):
            ids, texts, *keys = (c.to_pylist() for c in table.columns)
            for lo, hi in one.runs(texts):
                raw = [r + end for r in one.encode(texts[lo:hi])]
                rows = [(block_of(bounds, k), *k, d, len(r) // one.kind.itemsize, packer.compress(r)) for d, r, k in zip(ids[lo:hi], raw, zip(*(k[lo:hi] for k in keys)))]
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "k0", "k1", "k2", "doc_id", "n", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dictionary = given.value
        system, folder = fs.FileSystem.from_uri(path)
        digest = hashlib.sha256(dictionary).digest()
        held: list[tuple] = []
        done: list[tuple] = []
        held_bytes = part = 0

        def close() -> None:
            block, name = held[0][0], f"{folder}/ids-{held[0][0]:08d}-{part:06d}.bin"
            ends = np.cumsum([len(x[3]) for x in held])
            mine = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(mine) as f:
                f.write(MAGIC + digest + struct.pack("<Q", len(held)))
                f.write(b"".join(struct.pack("<qQ", d or 0, int(e) | (_NULL if d is None else 0)) for (_, d, _, _), e in zip(held, ends)))
                for x in held:
                    f.write(x[3])
            system.move(mine, name)
            done.append((block, part, name, len(held), sum(x[2] for x in held)))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6))):
                if held and (held[0][0] != row[0] or held_bytes > file_bytes):
                    close()
                    part, held_bytes = (part + 1 if done[-1][0] == row[0] else 0), 0
                held.append(row)
                held_bytes += len(row[3])
        if held:
            close()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 5, kinds)], names=["block", "part", "file", "n_docs", "n_ids"])

    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/dictionary.zstd") as f:
        f.write(dictionary)
    frames = docs.mapInArrow(encode, "block long, k0 long, k1 long, k2 long, doc_id long, n long, frame binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(bounds) // BLOCKS_PER_TASK))
    in_order = frames.repartition(parts, "block").sortWithinPartitions("block", "k0", "k1", "k2")
    return store(in_order.mapInArrow(write, "block long, part long, file string, n_docs long, n_ids long"), "id-manifest")


def train_on(docs: DataFrame, keys: DataFrame, tokenizer_path: str, end_id: int, sample: int, sample_bytes: int, dictionary_bytes: int) -> bytes:
    """A dictionary from pieces of ``sample`` documents, the ones with the smallest hashes; where a piece begins is a hash too."""
    # the sample alone is cut: a long document would teach the dictionary nothing but itself
    places = F.greatest(F.length("text") - 2 * sample_bytes, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("k1", "k2", F.lit(31)), places) + 1).cast("int")
    draw = F.xxhash64("k1", "k2", F.lit(29))
    last = keys.select(draw.alias("draw")).orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    cut = docs.where(draw <= F.lit(last)).select("k1", "k2", F.substring(F.col("text"), begin, F.lit(2 * sample_bytes)).alias("text"))
    some = cut.orderBy(draw, "k1", "k2").select("text").limit(sample)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(tokenizer_path)
        end = np.array([end_id], one.kind).tobytes()
        for batch in batches:
            raw = [(r + end)[:sample_bytes] for r in one.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    return train([bytes(r.raw) for r in some.mapInArrow(pieces, "raw binary").collect()], dictionary_bytes)


def read_header(f, digest: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, null flags, frame ends, where the data begin)."""
    head = f.read(48)
    if head[:8] != MAGIC or head[8:40] != digest:
        raise ValueError("not an id file, or one that needs another dictionary")
    n = struct.unpack("<Q", head[40:])[0]
    index = np.frombuffer(f.read(16 * n), "<i8").reshape(n, 2)
    return index[:, 0], (index[:, 1] & _NULL) != 0, index[:, 1] & (_NULL - 1), 48 + 16 * n


def read_ids(spark: SparkSession, manifest: DataFrame, path: str, kind: str = "<u2") -> DataFrame:
    """(doc_id, start, token_ids): every document of the files, in order of ``start``, ids as 32-bit integers."""
    ship(spark)
    # one row per file, sums only: as many as blocks, which are bounded
    files = manifest.select("block", "part", "n_ids").orderBy("block", "part").collect()
    begins = dict(zip([(r.block, r.part) for r in files], np.cumsum([0, *[r.n_ids for r in files]]).tolist()))
    given = spark.sparkContext.broadcast(begins)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        with system.open_input_file(f"{folder}/dictionary.zstd") as f:
            dictionary = f.read()
        digest = hashlib.sha256(dictionary).digest()
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for block, part, file in zip(*(c.to_pylist() for c in batch.columns)):
                start = given.value[block, part]
                with system.open_input_file(file) as f:
                    ids, nulls, ends, _ = read_header(f, digest)
                    sizes = np.diff(ends, prepend=0)
                    for at in range(0, len(ids), 256):
                        rows = []
                        for k in range(at, min(at + 256, len(ids))):
                            raw = np.frombuffer(unpacker.decompress(f.read(int(sizes[k]))), kind)
                            rows.append((None if nulls[k] else int(ids[k]), start, raw.astype("<u4").tobytes()))
                            start += len(raw)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "token_ids"])

    listed = manifest.select("block", "part", "file")
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(tasks, "block", "part").mapInArrow(read, "doc_id long, start long, token_ids binary")


def read_one(path: str, file: str, row: int, kind: str = "<u2") -> np.ndarray:
    """The ids of one document: two index entries and its frame are read, nothing else."""
    system, folder = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{folder}/dictionary.zstd") as f:
        dictionary = zstandard.ZstdCompressionDict(f.read())
    with system.open_input_file(file) as f:
        f.seek(40)
        n = struct.unpack("<Q", f.read(8))[0]
        f.seek(48 + 16 * max(0, row - 1))
        entries = np.frombuffer(f.read(16 if row == 0 else 32), "<i8").reshape(-1, 2)[:, 1] & (_NULL - 1)
        begin, end = (0, int(entries[0])) if row == 0 else map(int, entries)
        f.seek(48 + 16 * n + begin)
        return np.frombuffer(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(f.read(end - begin)), kind)


def id_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "ids")
