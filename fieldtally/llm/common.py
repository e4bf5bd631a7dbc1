"""What several of these operators share: shipping the package, narrow inputs, ordered blocks."""

from __future__ import annotations

import bisect
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Whole texts go to Python in batches of about so many bytes: a batch is held several times, in the executor and in its worker.
BATCH_BYTES = 1 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers (once per application), and bound its batches unless the user has."""
    if spark.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="fieldtally-code-")) / "fieldtally_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    sc.addPyFile(str(archive))  # the driver serves it; no executor reads the driver's folder
    _shipped.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Words of a text; no text, none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: Column, tie: Column) -> list[Column]:
    """Ascending ids, missing ones last; equal ids by ``tie``."""
    return [id_col.isNull().cast("long"), F.coalesce(id_col, F.lit(0)).cast("long"), tie]


def block_bounds(keys: DataFrame, rows_per_block: int = 2000, max_blocks: int = 65_536, oversample: int = 16) -> list[tuple]:
    """First keys of blocks of roughly equal size, in order; each one is the key of a row.

    ``keys`` has the columns of :func:`order_key`.  The driver receives ``max_blocks * oversample``
    keys at most (a sample by hash, about ``oversample`` to a block) and the smallest key.
    """
    cols = keys.columns
    rows = keys.count()
    if not rows:
        return []
    blocks = max(1, min(max_blocks, rows // rows_per_block))
    step = max(1, rows // (blocks * oversample))
    # both parts of the key take part in the hash, so ids with a pattern are sampled evenly
    sample = keys.where(F.pmod(F.xxhash64(*cols, F.lit(17)), F.lit(step)) == 0) if step > 1 else keys
    found = sorted({tuple(r) for r in sample.collect()})
    first = tuple(keys.agg(F.min(F.struct(*cols)).alias("m")).first().m)
    width = max(1, -(-len(found) // blocks))
    return sorted({first, *found[::width]})


def block_of(bounds: list[tuple], key: tuple) -> int:
    return max(0, bisect.bisect_right(bounds, key) - 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Like :func:`free_name`, for several names at once; they differ from each other too."""
    out: list[str] = []
    taken = {c.lower() for c in df.columns}
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
