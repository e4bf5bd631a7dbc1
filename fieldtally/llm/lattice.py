"""Language-model scores: marginal probability over all segmentations into subwords.

A word's probability is the sum over every way to cut it into pieces of a vocabulary, each piece weighted by its
unigram probability; a forward recursion in log space adds the ways up.  The vocabulary is that of a
public tokenizer, used as it is; its scores order the pieces, which gives the first weights (one over rank).  Expected
piece counts over the training words (forward and backward) replace them in ``rounds`` passes.

A document's words are independent given the pieces, so each distinct word is scored once, over its row in the table
of word counts, and documents look their words up.  Words met most often (``common`` of them at most, short ones)
are sent to every task; the long tail of rare words is joined.  Characters without a piece fall back to bytes.

Training documents are those whose crc32 of the id, as text, is not divisible by 10; the others are held out.  A
missing id counts as the empty text (held out).  Null text is empty: one token, the end.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import WORD, ship, text_or_empty

_WORD = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)
SPACE = "▁"  # how the vocabulary writes the beginning of a word
NONE = float("-inf")


def add_logs(terms: list[float]) -> float:
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


class Lattice:
    """Pieces with log probabilities; ``byte``: those of the 256 bytes, for characters without a piece."""

    def __init__(self, pieces: dict[str, float], byte: list[float]):
        self.pieces, self.byte = pieces, byte
        self.longest = max(map(len, pieces), default=1)

    def edges(self, s: str) -> list[list[tuple[int, float, str | None]]]:
        """For each end, the pieces that end there: (begin, log probability, piece or None for bytes)."""
        get, longest = self.pieces.get, self.longest
        out = []
        for j in range(1, len(s) + 1):
            here = [(i, p, x) for i in range(max(0, j - longest), j) if (p := get(x := s[i:j])) is not None]
            if s[j - 1] not in self.pieces:
                here.append((j - 1, sum(self.byte[b] for b in s[j - 1].encode("utf-8", "replace")), None))
            out.append(here)
        return out

    def forward(self, edges: list) -> list[float]:
        a = [0.0]
        for here in edges:
            a.append(a[here[0][0]] + here[0][1] if len(here) == 1 else add_logs([a[i] + p for i, p, _ in here]))
        return a

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the probability of a word."""
        return self.forward(self.edges(SPACE + word))[-1]

    def expect(self, word: str, times: float, into: dict) -> None:
        """Adds the expected number of each piece in ``times`` occurrences of the word."""
        s = SPACE + word
        edges = self.edges(s)
        a, n = self.forward(edges), len(s)
        total = a[-1]
        back: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
        for j in range(n, 0, -1):
            b = add_logs(back[j]) if len(back[j]) > 1 else (back[j][0] if back[j] else NONE)
            if b == NONE:
                continue
            for i, p, x in edges[j - 1]:
                back[i].append(p + b)
                weight = times * math.exp(a[i] + p + b - total)
                if x is not None:
                    into[x] += weight
                else:
                    for byte in s[i].encode("utf-8", "replace"):
                        into[byte] += weight


class Lattices:
    """The same recursions for many words at once: words of one length are rows, their pieces are found by hash.

    Long words, and words with a character that has no piece, go one by one through :class:`Lattice`.
    """

    LONG = 48
    SLOTS = 1 << 19

    def __init__(self, one: Lattice):
        self.one = one
        self.names = sorted(one.pieces)
        self.logs = np.array([one.pieces[p] for p in self.names])
        self.chars = np.zeros(0x110000, bool)
        self.chars[[ord(p) for p in self.names if len(p) == 1]] = True
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.ids = np.full(self.SLOTS, -1, np.int32)
        hashes = np.zeros(len(self.names), np.uint64)
        codes = [np.array([ord(c) for c in p], np.uint64) for p in self.names]
        for k in range(one.longest):
            rows = np.array([i for i, c in enumerate(codes) if len(c) > k])
            hashes[rows] = self.roll(hashes[rows], np.array([codes[i][k] for i in rows], np.uint64))
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        taken = set()
        for i, (h, slot) in enumerate(zip(hashes, self.slot(hashes).tolist())):
            while slot in taken:
                slot = (slot + 1) % self.SLOTS
            taken.add(slot)
            self.keys[slot], self.ids[slot] = h, i

    @staticmethod
    def roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(45)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, or -1."""
        slot = self.slot(h)
        ids, same = self.ids[slot], self.keys[slot] == h
        out = np.where(same & (ids >= 0), ids, -1)
        on = np.flatnonzero(~same & (ids >= 0))  # the slot is another piece's: look at the next
        while len(on):
            slot[on] = (slot[on] + 1) % self.SLOTS
            ids, same = self.ids[slot[on]], self.keys[slot[on]] == h[on]
            out[on[same & (ids >= 0)]] = ids[same & (ids >= 0)]
            on = on[~same & (ids >= 0)]
        return out

    def grouped(self, words: list[str]):
        """(row numbers, codes of the words with their mark in front) of each length, and the rows left over."""
        by_length: dict[int, list[int]] = defaultdict(list)
        rest: list[int] = []
        for k, w in enumerate(words):
            (by_length[len(w)] if 0 < len(w) < self.LONG and "\0" not in w else rest).append(k)
        groups = []
        for length, rows in by_length.items():
            codes = np.array([SPACE + words[k] for k in rows], f"<U{length + 1}").view(np.uint32).reshape(len(rows), length + 1)
            fine = self.chars[np.minimum(codes, 0x10FFFF)].all(axis=1)
            rest += [k for k, ok in zip(rows, fine) if not ok]
            if fine.any():
                groups.append((np.array(rows)[fine], codes[fine]))
        return groups, rest

    def pieces_in(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows that have a piece there, its number), by begin."""
        n, length = codes.shape
        wide = codes.astype(np.uint64)
        found = []
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.one.longest) + 1):
                h = self.roll(h, wide[:, j - 1])
                ids = self.find(h)
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    found.append((i, j, rows, ids[rows]))
        return found

    def forward(self, codes: np.ndarray, found: list) -> np.ndarray:
        a = np.full((codes.shape[1] + 1, len(codes)), NONE)
        a[0] = 0.0
        for i, j, rows, ids in found:  # by begin: all that ends at i has been added
            a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + self.logs[ids])
        return a

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        groups, rest = self.grouped(words)
        for rows, codes in groups:
            out[rows] = self.forward(codes, self.pieces_in(codes))[-1]
        for k in rest:
            out[k] = self.one.log_probability(words[k])
        return out

    def expect(self, words: list[str], times: list[int], into: np.ndarray, others: dict) -> None:
        """Adds the expected counts of all pieces to ``into``, those of words done one by one to ``others``."""
        groups, rest = self.grouped(words)
        weights = np.array(times, float)
        for at, codes in groups:
            found = self.pieces_in(codes)
            a = self.forward(codes, found)
            b = np.full_like(a, NONE)
            b[-1] = 0.0
            for i, j, rows, ids in sorted(found, key=lambda x: -x[1]):  # by end: all that begins at j has been added
                b[i, rows] = np.logaddexp(b[i, rows], b[j, rows] + self.logs[ids])
            mass = np.log(weights[at]) - a[-1]
            if found:
                ids = np.concatenate([x[3] for x in found])
                share = np.concatenate([np.exp(a[i, rows] + self.logs[x] + b[j, rows] + mass[rows]) for i, j, rows, x in found])
                into += np.bincount(ids, share, len(into))
        for k in rest:
            self.one.expect(words[k], times[k], others)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Several batches as one, so that words of one length are many."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def vocabulary(path: str) -> tuple[dict[str, float], list[float]]:
    """Weights of the pieces and of the bytes, one over rank by the vocabulary's own scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte = {}, [0.0] * 256
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
    for rank, i in enumerate(sorted(ids, key=lambda i: (-model.get_score(i), i))):
        weight = 1.0 / (rank + 10)
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[3:-1], 16)] = weight
        else:
            pieces[model.id_to_piece(i)] = weight
    return pieces, byte


def normalised(pieces: dict[str, float], byte: list[float], other: float) -> Lattice:
    total = sum(pieces.values()) + sum(byte) + other
    return Lattice({k: math.log(v / total) for k, v in pieces.items()}, [math.log(max(v, 1e-9) / total) for v in byte])


def is_training(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 10 != 0


def word_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n, c): occurrences of each word, and those in training documents; summed before they are shuffled."""
    text = F.translate(text_or_empty(text_col), UPPER, LOWER)
    words = df.select(is_training(id_col).cast("long").alias("train"), F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word"))
    return store(words.groupBy("word").agg(F.count("*").alias("n"), F.sum("train").alias("c")), "lm-words")


def learn(counts: DataFrame, documents: int, path: str, rounds: int, prior: float) -> tuple[Lattice, float]:
    """The lattice with learnt weights, and the log probability of a document's end."""
    spark = counts.sparkSession
    first_pieces, first_byte = vocabulary(path)
    scale = prior / (sum(first_pieces.values()) + sum(first_byte))
    pieces, byte = {k: v * scale for k, v in first_pieces.items()}, [v * scale for v in first_byte]
    now = dict(pieces), list(byte)
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(normalised(*now, documents))

        def expected(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            many = Lattices(given.value)
            into, others = np.zeros(len(many.names)), defaultdict(float)
            for table in gathered(batches):
                many.expect(table.column(0).to_pylist(), table.column(1).to_pylist(), into, others)
            for i in np.flatnonzero(into):
                others[many.names[i]] += float(into[i])
            rows = [(k if isinstance(k, str) else f"\0{k}", v) for k, v in others.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [(), ()], (pa.string(), pa.float64()))], names=["piece", "e"])

        sums = counts.where("c > 0").select("word", "c").mapInArrow(expected, "piece string, e double").groupBy("piece").agg(F.sum("e").alias("e"))
        now = dict(pieces), list(byte)
        for r in sums.collect():  # a row per piece of the vocabulary at most
            if r.piece[0] == "\0":
                now[1][int(r.piece[1:])] += r.e
            else:
                now[0][r.piece] += r.e
        given.unpersist()
    total = sum(now[0].values()) + sum(now[1]) + documents
    return normalised(*now, documents), math.log(max(documents, 0.1) / total)


def score_documents(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", common: int = 50_000, rounds: int = 1, prior: float = 1000.0
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``df``."""
    spark = df.sparkSession
    ship(spark)
    counts = word_counts(df, id_col, text_col)
    training = df.where(is_training(id_col)).count()
    sums = counts.agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = (sums.c or 0) + training, (sums.v or 0) + (training > 0)
    floor = n + 0.1 * (v + 1)
    lattice, end = learn(counts, training, path, rounds, prior)
    model = spark.sparkContext.broadcast(lattice)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = Lattices(model.value)
        for table in gathered(batches):
            scores = pa.chunked_array([pa.array(many.log_probabilities(table.column(0).to_pylist()), pa.float64())])
            yield from pa.Table.from_arrays([*table.columns, scores], names=["word", "n", "c", "score"]).to_batches()

    words = store(counts.select("word", "n", "c").mapInArrow(score_words, "word string, n long, c long, score double"), "lm-scored-words")
    frequent = words.where(F.length("word") <= 64).orderBy(F.col("n").desc(), "word").limit(common)
    near = {r.word: (r.c, math.log10((r.c + 0.1) / floor), r.score) for r in frequent.collect()}  # ``common`` rows at most
    table = spark.sparkContext.broadcast(near)
    end_base = math.log10((training + 0.1) / floor)

    def score_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.get
        for batch in batches:
            rows, rare = [], []
            for text in batch.column(3).to_pylist():
                found = Counter(_WORD.findall(text.translate(_LOWER)))
                known, base, score = int(training > 0), end_base, end
                others = []
                for word, times in found.items():
                    hit = get(word)
                    if hit is None:
                        others.append({"word": word, "times": times})
                    else:
                        known += times if hit[0] else 0
                        base += times * hit[1]
                        score += times * hit[2]
                rows.append((sum(found.values()) + 1, known, base, score))
                rare.append(others)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
            )

    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (~is_training(id_col)).alias("held_out"), text_or_empty(text_col).alias("text"))
    begun = store(
        docs.mapInArrow(score_common, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,times:long>>"),
        "lm-begun",
    )
    rare = begun.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    tail = words.select("word", "c", F.col("score").alias("word_score"))
    looked_up = rare.join(tail, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        F.sum(F.col("times") * F.log10((F.col("c") + 0.1) / floor)).alias("base_more"),
        F.sum(F.col("times") * F.col("word_score")).alias("score_more"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return begun.drop("rare").join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known_more")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"), ((F.col("score") + zero("score_more")) / F.lit(math.log(10))).alias("score"),
    )
