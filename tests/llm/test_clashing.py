"""The pipeline's stages keep columns whose names look like their own."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from fieldtally.llm import bpe, mixing, neardup, pii
from tests.llm.test_llm import ROWS, folder

NAMES = ["_text", "_key", "_d", "d", "node", "key", "_size", "size_", "_copies", "copies", "s", "z", "rows", "low", "extra", "k", "nth", "_row", "_base", "_cands", "given", "_b_ip", "stays", "none", "c0", "a.b"]


def wide(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def check(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    for r in rows:
        d = "-" if r.doc_id is None else str(r.doc_id)
        assert all(r[n] == f"{n}:{d}" for n in NAMES) and (r["size"], r["kept"], r["quality"], r["spans"]) == (1, "x", 2, 3)
    return rows


def test_clashing_names(spark, tmp_path):
    docs = wide(spark, folder(spark, tmp_path / "a", ROWS, []))
    changed = check(pii.redact(docs), docs)
    assert len(changed) == len(ROWS) and any("[EMAIL]" in (r.text or "") for r in changed) and any(r.text is None for r in changed)
    assert 0 < len(check(neardup.one_of_each(docs), docs)) < len(ROWS)
    assert len(check(mixing.copied(docs, mixing.mix(docs)), docs)) > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        check(stage(spark, docs, ""), docs)


def test_batches_of_the_coder(spark):
    """Runs, remembered words that are pushed out, and one text longer than a run give the ids of single texts."""
    import public_tokenizers

    one = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    other = bpe.Coder(one.ranks, public_tokenizers.PATTERN)
    other.RUN, other.parts.most, other.PAIRS = 50, 3, 5
    texts = [t or "" for _, t, *_ in ROWS] + ["wordsandwords. " * 9, "", "a, b; c! d? e: f.", " lead", "tail ", "x" * 3000 + " y"]
    whole = one.encode_all(texts)
    assert whole == other.encode_all(texts) == [one.encode(t) for t in texts]
    assert one.decode_all(whole) == other.decode_all(whole) == [t.encode() for t in texts]
