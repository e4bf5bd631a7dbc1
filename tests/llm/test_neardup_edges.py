"""Near duplicates at the edges of the threshold, and in buckets made by hand."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from fieldtally.llm import neardup


def run_of(name, n):
    """A text of ``n`` different shingles; the texts of one name are cut from one sequence."""
    return [f"{name}w{i}" for i in range(n + 4)]


def node(text):
    return hashlib.md5(text.encode()).digest()


def classes_in(spark, monkeypatch, texts, buckets):
    """Class of each text when the texts meet in the given buckets only."""
    rows = [(i, bytearray(node(t)), [b for b, inside in buckets.items() if i in inside]) for i, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "doc_id long, node binary, buckets array<long>")
    monkeypatch.setattr(neardup, "signed", lambda *_: neardup.ship(spark) or given)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in neardup.class_ids(*neardup.near_duplicates(df)).collect()}


def named(make, order):
    """The texts of the first name whose checksums ascend in ``order``, so that it is known who becomes hub."""
    for k in range(10_000):
        texts = make(f"n{k}")
        if all(node(texts[a]) < node(texts[b]) for a, b in zip(order, order[1:])):
            return texts


def test_similarity_of_single_counts_is_one_division():
    for union in range(5, 5001, 5):
        common = union * 4 // 5
        a, b = (np.arange(n, dtype=np.uint64) for n in (common, union))
        for x, y in ((1.0, 1.0), (2.0, 2.0), (1.0, 3.0)):
            assert neardup.similarity((a, np.full(common, x)), (b, np.full(union, y))) == 0.8


def test_pairs_of_exactly_the_threshold_are_linked(spark):
    docs, want = [], {}
    for k in range(3, 43):
        whole = run_of(f"p{k}", 5 * k)
        for common in (4 * k, 4 * k - 1):
            i = len(docs)
            name = f"c{common}"
            docs += [(i, " ".join(name + w for w in whole)), (i + 1, " ".join(name + w for w in whole[: common + 4]))]
            want[i] = 5 * common >= 4 * 5 * k
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.class_ids(*neardup.near_duplicates(df)).collect()}
    assert {i: got[i + 1] == i for i in want} == want


@pytest.mark.parametrize("m", [3, 12, 16])
def test_triangle_bounds_hold_at_equality(spark, monkeypatch, m):
    def make(name):  # similarities 0.8, 0.8 and, of the outer two, 0.6
        words = run_of(name, 10 * m)
        return [" ".join(words[: 8 * m + 4]), " ".join(words), " ".join(words[2 * m :])]

    texts = named(make, (0, 1, 2))
    assert classes_in(spark, monkeypatch, texts, {1: {0, 1, 2}}) == {0: 0, 1: 0, 2: 0}


def test_members_linked_over_others_stay_in_a_bucket_with_unlike_ones(spark, monkeypatch):
    """Hub and third text are linked over the second; only the third is like the fourth, which is unlike the hub."""

    def make(name):  # steps of 0.818 between neighbours, hub to fourth 0.538
        words = run_of(name, 200)
        return [" ".join(words[10 * i : 10 * i + 104]) for i in range(4)]

    texts = named(make, (0, 1, 2, 3))
    assert classes_in(spark, monkeypatch, texts, {1: {0, 2, 3}, 2: {0, 1}, 3: {1, 2}}) == dict.fromkeys(range(4), 0)


def test_drifting_chains_over_a_shared_passage(spark, monkeypatch):
    """Every pair of a bucket that is like enough is linked, whoever becomes hub: against all pairs."""
    r = random.Random(4)
    texts = []
    for chain in range(3):
        words = run_of(f"chain{chain}", 400)
        texts += [" ".join(run_of("passage", 16) + words[9 * i : 9 * i + 90]) for i in range(24)]
    near = [{i, i + 1} for i in range(len(texts) - 1) if r.random() < 0.7]
    buckets = dict(enumerate(near + [set(r.sample(range(len(texts)), 24)) for _ in range(6)]))
    parts = [neardup.Shingler(5)(t) for t in texts]
    want = list(range(len(texts)))
    for inside in buckets.values():
        for a in inside:
            for b in inside:
                if a < b and neardup.similarity(parts[a], parts[b]) >= 0.8 and want[a] != want[b]:
                    low, high = sorted((want[a], want[b]))
                    want = [low if x == high else x for x in want]
    assert len(set(want)) > 3 and classes_in(spark, monkeypatch, texts, buckets) == dict(enumerate(want))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_give_every_alike_pair_of_different_components(spark, block):
    """However the two sides of a bucket are cut: against all pairs, signatures of 64 places."""
    r = np.random.default_rng(5)
    base = r.integers(0, 256, 64)
    marks = [bytes(np.where(r.random(64) < 0.25, r.integers(0, 256, 64), base).astype(np.uint8)) for _ in range(40)]
    nodes = [bytes([i]) * 16 for i in range(40)]
    label = [i % 5 if i % 3 else i for i in range(40)]  # some share a component
    members = {(0, 7): (range(0, 25), range(25, 40)), (3, 7): (range(10, 40),) * 2, (1, 9): ([1], range(2, 9))}
    rows = [(t, b, nodes[i], i in ins, i in outs, len(ins), len(outs)) for (t, b), (ins, outs) in members.items() for i in sorted({*ins, *outs})]
    sides = spark.createDataFrame(rows, "turn int, bucket long, node binary, inner boolean, outer boolean, n_inner long, n_outer long")
    labels = spark.createDataFrame([(nodes[i], nodes[label[i]]) for i in range(40)], "node binary, label binary")
    given = spark.createDataFrame(list(zip(nodes, marks)), "node binary, marks binary")
    low = neardup.least_agreement(64, 0.8)
    found = neardup.alike_in_blocks(sides, labels, given, 64, low, 48, block).collect()
    got = {(bytes(r.a)[0], bytes(r.b)[0]): r.agree for r in found}
    want = {}
    for ins, outs in members.values():
        for a in ins:
            for b in outs:
                agree = sum(x == y for x, y in zip(marks[a], marks[b]))
                if label[a] != label[b] and low <= agree < 48:
                    want[min(a, b), max(a, b)] = agree
    assert got == want and len(found) == len(want) and 20 < len(want) < 700
