"""Findings of the third review: memory of the pipeline, time of the id files."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from fieldtally.llm import bpe, common, idfiles, neardup


def test_batches_of_texts_are_bounded(spark):
    """Texts of 24 MB in one partition reach Python in pieces of a few."""
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(char(97 + CAST(id % 26 AS INT)), 8000) AS text")
    before = spark.conf.get(common._BATCH_KEY)
    spark.conf.set(common._BATCH_KEY, common._BATCH_DEFAULT)
    try:
        neardup.signed(docs, "doc_id", "text", 5, 4, 2)  # any operator that hands whole texts to Python

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(common._BATCH_KEY, before)
    assert sum(found) > 24_000_000 and max(found) < 1.5 * common.BATCH_BYTES


def test_bound_of_the_user_stays(spark):
    before = spark.conf.get(common._BATCH_KEY)
    spark.conf.set(common._BATCH_KEY, "9000000b")
    try:
        common.ship(spark)
        assert spark.conf.get(common._BATCH_KEY) == "9000000b"
    finally:
        spark.conf.set(common._BATCH_KEY, before)


def test_pieces_side_by_side_have_the_ids_of_the_library():
    one = idfiles.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    some = ["a", "B", "\u00e9", "1", " ", "\n", " ", ".", ",", "'s", "\t", "\r", " ", "\x1c", "_", "\u00b2", "\u6f22", "\U0001f600", "<|endoftext|>", "\x85", "don't", "  ", "\n\n"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    found = [ids for at in range(0, len(texts), 500) for ids in one.encode(texts[at : at + 500])]
    told = one.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert found == [np.array(e.ids, one.kind).tobytes() for e in told]


def test_unknown_pieces_are_few_calls():
    """A thousand words that were not met go to the library as a few texts, not as a thousand."""
    one = idfiles.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    library, given = one.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return library.encode_batch_fast(texts, **how)

    one.tokenizer = Counting()
    text = " ".join(f"w{i}x" for i in range(1000))
    assert one.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, one.kind).tobytes()]
    assert len(given) < 10


def test_repeated_pieces_cost_no_bytes_of_their_own():
    """Ids of all pieces lie in one table; the cache, when it is full, keeps the pieces at hand and forgets the others."""
    one = idfiles.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    one.KEPT = 60
    draw = random.Random(5)
    for turn in range(30):
        words = [f"w{draw.randint(0, 40 + turn)}{draw.choice(['', 'x', '.', chr(10)])}" for _ in range(60)]
        texts = [" ".join(words[at : at + 9]) for at in range(0, 60, 9)] + ["", " ", "y" * 100, " a  b"]
        told = one.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert one.encode(texts) == [np.array(e.ids, one.kind).tobytes() for e in told]
        assert len(one.known) <= one.KEPT and len(one.begins) == len(one.sizes) and one.sizes.sum() == len(one.table)
        assert all(isinstance(place, int) for place in one.known.values())


def test_small_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100])], names=["t"]) for _ in range(50)]
    found = [len(t) for t in idfiles.together(iter(batches), 1200)]
    assert sum(found) == 50 and len(found) < 8


def test_coder_in_a_worker_stays_small():
    """Words that hardly repeat, as in the pipeline on 0.51 GB: what the coder remembers is bounded by far less than it was."""
    one = bpe.Coder({bytes([i]): i for i in range(256)}, public_tokenizers.PATTERN)
    for at in range(0, 400_000, 50_000):
        one.encode_all([" ".join(f"w{i}" for i in range(at, at + 50_000))])
    assert len(one.parts.young) + len(one.parts.old) <= 120_000 and common.BATCH_BYTES <= 1 << 20


def test_decoding_holds_no_index_of_every_byte():
    """A worker's memory follows the text, not eight bytes and more for each byte of it."""
    one = bpe.Coder({bytes([i]): i for i in range(256)}, public_tokenizers.PATTERN)
    packed = [np.frombuffer(b"some words " * 4000, np.uint8).astype("<u4").tobytes()] * 24
    tracemalloc.start()
    back = one.decode_all(packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == [b"some words " * 4000] * 24
    assert peak < 4 * sum(map(len, back))
