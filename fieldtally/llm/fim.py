"""Fill-in-the-middle form of documents, cut at tokens that are counted chunk by chunk.

A rolling hash over the last 16 bytes cuts a text into chunks by its content, so a passage that many documents share
is cut alike in all of them.  What a chunk holds (tokens that begin in it, characters, whether its first and last
characters belong to a word) is worked out once and remembered under the chunk's own bytes: a chunk met again is
compared in full, never by its hash alone.  The summaries of neighbouring chunks add up; where one chunk ends inside a
word and the next begins inside one, the two halves are one token.  The running sums say in which chunk a cut lies,
and only that chunk is looked at for the place.

A token is a word with the white space before it; white space at the end of a text is a token of its own.  Null
text counts as empty.  An empty text, one that holds a marker, and by chance half of the others, stay plain: their
output is the text itself.  Null ids draw like the empty string; rows of one id draw alike; repeated rows get equal
results.  Every row gives a row, in an empty table none.  Texts of any length are cut whole; a task holds one text, its
chunk table (bounds of about one chunk a KiB) and a bounded memory of chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

WINDOW = 16  # bytes the rolling hash looks back on
LEAST, MOST = 256, 8192  # bytes of a chunk
_MASK = np.uint32(1023 << 22)  # a cut at about one byte in 1,024
_STRIDE = 1 << 20  # bytes hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IN_WORD = ~_SPACE
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_SCRAMBLED = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def places(raw: np.ndarray) -> np.ndarray:
    """Positions before which the rolling hash of the last bytes allows a cut; always between two characters."""
    found = []
    for at in range(0, len(raw), _STRIDE):
        start = max(0, at - WINDOW)
        h = _SCRAMBLED[raw[start : at + _STRIDE]]
        for shift in (1, 2, 4, 8):  # after this, the sum of the last 16 values, each shifted by its age
            older = np.zeros_like(h)
            older[shift:] = h[:-shift] << np.uint32(shift)
            h = h + older
        here = np.flatnonzero((h[at - start :] & _MASK) == 0) + at + 1
        found.append(here)
    cuts = np.concatenate(found) if found else np.empty(0, np.int64)
    cuts = cuts[cuts < len(raw)]
    return cuts[_STARTS_CHAR[raw[cuts]]]


def bounds(raw: np.ndarray) -> list[int]:
    """Chunk bounds, 0 and the length included: no chunk but the last is shorter than LEAST, none longer than MOST."""
    out, last = [0], 0
    for cut in [*places(raw).tolist(), len(raw)]:
        while cut - last > MOST:
            last += MOST
            while not _STARTS_CHAR[raw[last]]:
                last -= 1
            out.append(last)
        if cut - last >= LEAST or cut == len(raw) and cut > last:
            out.append(cut)
            last = cut
    return out


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(words that begin in the chunk, characters, begins in a word, ends in a word)."""
    raw = np.frombuffer(chunk, np.uint8)
    word = _IN_WORD[raw]
    starts = int(np.count_nonzero(word[1:] > word[:-1])) + int(word[0])
    return starts, int(np.count_nonzero(_STARTS_CHAR[raw])), bool(word[0]), bool(word[-1])


class Summaries:
    """Summaries by content, in two generations of at most ``most`` bytes of chunks."""

    def __init__(self, most: int = 16 << 20):
        self.most, self.held, self.young, self.old = most, 0, {}, {}

    def __call__(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summary(chunk)
            if self.held + len(chunk) > self.most:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found


class Cuts:
    """The chunk table of one text: number of tokens, and where the first k of them end."""

    def __init__(self, text: bytes, of: Summaries):
        self.text = text
        self.at = bounds(np.frombuffer(text, np.uint8))
        parts = [of(text[a:b]) for a, b in zip(self.at, self.at[1:])]
        self.open = [False, *(p[3] for p in parts)]  # is the chunk entered inside a word?
        ended, begun, chars = [0], 0, [0]
        for k, (starts, n_chars, first, last) in enumerate(parts):
            begun += starts - (self.open[k] and first)
            ended.append(begun - last)  # words that have ended for certain before the next chunk
            chars.append(chars[-1] + n_chars)
        self.ended, self.chars = ended, chars
        if parts:
            ended[-1] = begun
        self.words = begun
        self.n = begun + int(bool(parts) and not parts[-1][3])

    def end_of(self, k: int) -> tuple[int, int]:
        """(bytes, characters) of the first ``k`` tokens."""
        if k == 0:
            return 0, 0
        if k > self.words or k == self.n:
            return len(self.text), self.chars[-1]
        chunk = int(np.searchsorted(self.ended, k)) - 1  # the k-th word ends in this chunk, or where it ends
        start, stop = self.at[chunk], self.at[chunk + 1]
        raw = np.frombuffer(self.text, np.uint8, stop - start, start)
        word = np.concatenate(([self.open[chunk]], _IN_WORD[raw], [stop < len(self.text) and bool(_IN_WORD[self.text[stop]])]))
        ends = np.flatnonzero(word[:-1] & ~word[1:])  # a word that reaches up to the chunk may end before its first byte
        place = int(ends[k - self.ended[chunk] - 1])
        return start + place, self.chars[chunk] + int(np.count_nonzero(_STARTS_CHAR[raw[:place]]))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def formed(text: bytes, cuts: Cuts, h: list[int], percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    n = cuts.n
    if not text or h[2] % 100 >= percent or any(m in text for m in _MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = cuts.end_of(first), cuts.end_of(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = _MARKS
    if h[3] % 100 < spm_percent:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


RESULT = StructType([
    StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()), StructField("output", StringType()),
])


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = 42, percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """Adds (or replaces) ``out``: a struct of n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``percent`` of the texts are transformed, ``spm_percent`` of those with the suffix first.  All other columns stay,
    whatever their names.
    """
    ship(df.sparkSession)
    known: list[Summaries] = []

    @F.arrow_udf(RESULT)
    def transform(ids: pa.Array, texts: pa.Array) -> pa.Array:
        if not known:
            known.append(Summaries())
        rows = []
        for doc_id, text in zip(ids, texts):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            rows.append(formed(raw, Cuts(raw, known[0]), draws(seed, doc_id.as_py()), percent, spm_percent))
        columns = [*zip(*rows)] if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        outputs = [c if i != 4 else [o.decode("utf-8") for o in c] for i, c in enumerate(columns)]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(outputs, kinds)], names=RESULT.names)

    return df.withColumn(out, transform(F.col(id_col).cast("long"), F.col(text_col)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    piece = lambda start, stop: F.substring(output, start + 3, stop - start - 3)
    last = F.substring(output, m + 3, F.length(output))
    psm = F.concat(piece(p, s), last, piece(s, m))
    spm = F.concat(piece(p, m), last, piece(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
