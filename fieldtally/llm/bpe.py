"""Byte-level BPE by longest matches and backtracking.

The bytes of a piece are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary
finds every token at every position in one pass.  The encoder goes from left to right with the longest
token, and falls back to the next shorter one, or to the position before, where two neighbours could
not stand side by side after the merges.  Whether two tokens can is decided by undoing their merges
towards the seam, and remembered; a position from which nothing led on is never tried again, so the work
is linear in the length of the piece and the ids are those that merging in rank order gives.

Longest tokens are looked up from a position on only when it is reached.

Null text counts as empty, and an empty text has no ids; an empty table gives an empty one.  Repeated rows get equal ids.
Texts of any length are encoded whole: texts are worked on in runs of about a quarter of a million characters, a longer one alone.
The words of a run are told apart first, so each is encoded once; the ids of at most 120,000 recent words are remembered.
What Arrow holds of a batch goes back to the system with it: workers live on, with the next operator's memory beside.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import ship

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: A single space between two characters that are not white space: every match of the pattern starts anew there.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"(?:^|\s) | (?:\s|$)")


def chunks(text: str) -> list[str]:
    """The text cut at single spaces, where the splitting pattern cuts it in any case.

    Each part but the first is meant to have its space in front: joined by single spaces, the parts are the text.
    """
    return _SEAM.split(text) if _ODD_SPACE.search(text) else text.split(" ")


class Recent:
    """What was met lately, in two generations of at most ``most`` entries each."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


def gathered(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``table`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def taken(table: pa.LargeBinaryArray, which: pa.Array, groups: list[int]) -> list[memoryview]:
    """The entries of ``table`` at ``which``, one after the other, cut into ``groups`` of so many entries.

    Arrow copies the bytes entry by entry; indexes for every byte would take eight times the room of the result.
    """
    found = table.take(which)
    _, offsets, raw = found.buffers()
    ends = np.frombuffer(offsets, np.int64, len(found) + 1, found.offset * 8)[np.cumsum([0, *groups])].tolist()
    joined = memoryview(raw or b"")
    return [joined[a:b] for a, b in zip(ends, ends[1:])]


class Coder:
    """Encoder and decoder for one file of ranks."""

    KEPT = 60_000  # entries of a cache generation, each at most LONGEST characters
    LONGEST = 48
    PAIRS = 100_000
    RUN = 1 << 18  # characters, or ids, that are worked on at once (a longer text alone)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.whole = {b.decode("latin-1"): i for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.parts = Recent(self.KEPT)
        self._undo_merges()
        n = max(ranks.values()) + 1
        self.lengths = [self.length.get(i, 0) for i in range(n)]
        self.shorters = [-1 if (x := self.shorter.get(i)) is None else x for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for s, i in self.whole.items():
            if i not in self.unmade:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        by_id = {i: b for b, i in ranks.items()}
        self.bytes_of = pa.array([by_id.get(i, b"") for i in range(n)], pa.large_binary())
        # what the pattern does with letters alone, and with one sign behind them
        self.letters = self.pattern.findall(" ab") == [" ab"]
        self.signs = {c for c in ".,;:!?" if self.letters and self.pattern.findall(f" ab{c}") == [" ab", c]}

    def _undo_merges(self) -> None:
        """The two tokens that each token is merged from, and its longest proper prefix that is a token."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.unmade: set[int] = set()  # ids that no sequence of merges reaches
        whole = self.whole
        for s, i in sorted(whole.items(), key=lambda x: x[1]):
            prefixes = [p for n in range(len(s) - 1, 0, -1) if (p := whole.get(s[:n])) is not None]
            self.shorter[i] = prefixes[0] if prefixes else None
            self.halves[i] = (i, i)
            if len(s) == 1:
                continue
            for left in prefixes:
                right = whole.get(s[self.length[left] :])
                if right is not None and left < i and right < i and self._fit(left, right):
                    self.halves[i] = (left, right)
                    self.merged[left, right] = i
                    break
            else:
                self.unmade.add(i)
        self.pairs.clear()  # what was asked while merges were still missing is no longer true
        for i in self.shorter:
            while (p := self.shorter[i]) in self.unmade:
                self.shorter[i] = self.shorter[p]

    def _fit(self, left: int, right: int) -> bool:
        """Can the two stand side by side when all merges are done?"""
        halves, merged = self.halves, self.merged
        limit = 1 << 40
        while True:
            if merged.get((left, right), limit) < limit:
                return False  # an earlier merge would have joined them
            if left > right:
                limit = left
                left = halves[left][1]
                if left != limit:
                    continue
                limit = right + 1
                right = halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit = right + 1
                right = halves[right][0]
                if right + 1 != limit:
                    continue
                limit = left
                left = halves[left][1]
                if left == limit:
                    return True

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        at_once = self.ranks.get(piece)
        if at_once is not None:
            return [at_once]
        length, shorter, pairs = self.lengths, self.shorters, self.pairs
        if len(pairs) > self.PAIRS:
            pairs.clear()
        text, n = piece.decode("latin-1"), len(piece)
        longest: dict[int, int] = {}  # by position, as far as they were asked for
        closed: set[int] = set()  # positions from which nothing leads on
        out: list[int] = []
        at, token, last = 0, -1, -1
        while True:
            token = longest.get(at, -1)
            if token < 0:  # the longest tokens from here on, one after the other, until they meet known ones
                place = at
                for _, found in self.automaton.iter_long(text, at):
                    if place in longest:
                        break
                    longest[place] = found
                    place += length[found]
                token = longest[at]
            while True:
                while token >= 0:
                    end = at + length[token]
                    if end not in closed:
                        if last < 0:
                            break
                        fits = pairs.get(last << 20 | token)
                        if fits is None:
                            fits = pairs[last << 20 | token] = self._fit(last, token)
                        if fits:
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                closed.add(at)
                token = out.pop()
                at -= length[token]  # its end is closed now, so it is replaced by a shorter one
                last = out[-1] if out else -1
            out.append(token)
            if end == n:
                return out
            at, last = end, token

    def encode_piece(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8", "replace"))
        return array("I", ids).tobytes() if _LITTLE else struct.pack(f"<{len(ids)}I", *ids)

    def encode_part(self, part: str) -> bytes:
        """Ids of a part of a text, with its space in front."""
        found = self.parts.get(part)
        if found is None:
            word = part[:-1] if part[-1:] in self.signs else part
            if self.letters and word.isalpha() and max(word) < "\u0250":  # letters alone are one piece
                found = self.encode_piece(" " + part) if word is part else self.encode_part(word) + self.encode_piece(part[-1])
            else:
                found = b"".join(map(self.encode_piece, self.pattern.findall(" " + part)))
            if len(part) <= self.LONGEST:
                self.parts.put(part, found)
        return found

    def encode_run(self, texts: list[str]) -> list[bytes]:
        firsts, flat, counts = [], [], []
        for text in texts:
            first, *parts = chunks(text)
            firsts.append(b"".join(map(self.encode_piece, self.pattern.findall(first))))
            flat += parts
            counts.append(len(parts))
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        del flat
        known = pa.array(map(self.encode_part, coded.dictionary.to_pylist()), pa.large_binary())
        return [first + rest for first, rest in zip(firsts, taken(known, coded.indices, counts))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for run in runs(texts, self.RUN) for ids in self.encode_run(run)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[bytes]:
        out = []
        for run in runs(packed, 4 * self.RUN):
            ids = pa.array(np.frombuffer(b"".join(run), "<u4"))
            out += map(bytes, taken(self.bytes_of, ids, [len(p) // 4 for p in run]))
        return out


def runs(values: list, most: int) -> Iterator[list]:
    """Neighbouring values of at most ``most`` characters or bytes together; a longer one alone."""
    run, held = [], 0
    for v in values:
        if run and held + len(v) > most:
            yield run
            run, held = [], 0
        run.append(v)
        held += len(v)
    if run:
        yield run


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    with open(path, "rb") as f:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds (or replaces) ``out``: the ids of ``text``, packed as little-endian unsigned 32-bit integers.

    ``path`` names a file of ranks that every worker has (it comes with an installed package); one worker
    holds one vocabulary and a cache of bounded size.  All other columns stay as they are.
    """
    ship(df.sparkSession)

    @F.arrow_udf(BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()
        one = coder(path, pattern)
        return pa.array(one.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds (or replaces) ``out``: the bytes that packed ids stand for; null ids give null."""
    ship(df.sparkSession)

    @F.arrow_udf(BinaryType())
    def raw(packed: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()
        one = coder(path, pattern)
        raws = pa.array(one.decode_all([p or b"" for p in packed.to_pylist()]), pa.binary())
        return pc.if_else(packed.is_null(), pa.scalar(None, pa.binary()), raws) if packed.null_count else raws

    return df.withColumn(out, raw(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "coded") -> DataFrame:
    """Adds (or replaces) ``out``: a struct of ``token_ids`` and ``decoded``, the bytes made from these ids again.

    One call for both: two functions, one on the other's result, would encode twice.
    """
    ship(df.sparkSession)

    @F.arrow_udf("token_ids binary, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()
        one = coder(path, pattern)
        ids = one.encode_all([t or "" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(one.decode_all(ids), pa.binary())], names=["token_ids", "decoded"])

    return df.withColumn(out, both(F.col(text)))

def n_ids(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")
