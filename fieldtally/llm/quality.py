"""Quality rules with compression bands.

A text that says the same again and again shrinks far below what prose does, and noise hardly shrinks at
all.  Each text is compressed as a whole, and in fixed chunks and the rest behind them (so that a long text
cannot hide a junk part behind good ones, or the other way round).  How far prose shrinks depends on how much of it there
is, so the limits go by length.  Beside the bands stand plain counts of words, symbols, repeated lines and
repeated five-word windows.

Null text counts as having no words and fails the rules, as empty text does.  Whole texts are read; the
memory of a task is that of one batch and one text's word numbers.  Repeated rows get equal verdicts, an empty table none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import WORD, ship

_WORD = re.compile(WORD)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]+")


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size.  ``whole``: (bytes up to, least, most), ascending.

    The upper limits from 257 bytes on lie between the highest ratio of clean prose (a 2 KiB chunk: 0.57) and the lowest
    of base64 and of random letters and digits (0.76); in shorter texts the two overlap.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (32, 0.0, 9.0), (64, 0.60, 1.70), (128, 0.55, 1.30), (256, 0.45, 1.00), (512, 0.42, 0.82), (1024, 0.38, 0.75),
        (2048, 0.34, 0.70), (4096, 0.31, 0.66), (8192, 0.29, 0.64), (32768, 0.27, 0.62), (float("inf"), 0.24, 0.62),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.30, 0.66)
    bad_chunks: float = 0.25  # a larger share of the bytes in chunks outside their limits rejects the text

    def limits(self, size: int) -> tuple[float, float]:
        """Of a text, or a rest shorter than a chunk, of so many bytes."""
        return next((least, most) for upto, least, most in self.whole if size <= upto)


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    window: int = 5
    repeat_percent: int = 20


FIELDS = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("ratio", DoubleType()), StructField("bad_chunk_share", DoubleType()), StructField("kept", BooleanType())]
)


def repeated_words(words: list[str], window: int) -> int:
    """Words inside windows that occur twice or more in the text; exact, by numbering equal windows."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    ids, counts = codes, None
    for k in range(1, window):  # equal (k + 1)-word windows get equal numbers
        _, ids, counts = np.unique(ids[: len(words) - k] * len(number) + codes[k:], return_inverse=True, return_counts=True)
    hit = counts[ids] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge(text: str, rules: Rules, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeats = repeated_words(words, rules.window)
    failed = len(words) < rules.least_words or 100 * repeats > rules.repeat_percent * len(words)
    raw = text.encode("utf-8", "replace")
    ratio = len(packer.compress(raw)) / max(1, len(raw))
    low, high = bands.limits(len(raw))
    size, bad = bands.chunk_bytes, 0
    for at in range(0, len(raw), size):
        part = raw[at : at + size]
        least, most = bands.chunk if len(part) == size else bands.limits(len(part))
        bad += len(part) * (not least <= len(packer.compress(part)) / len(part) <= most)
    share = bad / max(1, len(raw))
    return (
        len(words), sum(map(len, words)), sum(map(len, _SYMBOL.findall(text))), len(lines) - len(set(lines)), repeats,
        failed, ratio, share, not failed and low <= ratio <= high and share <= bands.bad_chunks,
    )


def quality(df: DataFrame, text: str = "text", out: str = "quality", rules: Rules = Rules(), bands: Bands = Bands()) -> DataFrame:
    """Adds (or replaces) the struct ``out`` with the counts, the ratios and ``kept``; other columns stay."""
    ship(df.sparkSession)

    @F.arrow_udf(FIELDS)
    def verdicts(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(t or "", rules, bands, packer) for t in texts.to_pylist()]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FIELDS.names)

    return df.withColumn(out, verdicts(F.col(text)))
