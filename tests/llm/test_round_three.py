"""Vector-approximation search, fill-in-the-middle and Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import fim, merkle, vafile
from fieldtally.llm.queries import ORACLES, QUERIES
from tests.compare import compare, oracle
from tests.llm.test_llm import ROWS, folder

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_vector_approximation", "op12_fill_in_middle", "op13_merkle_manifest"])
def test_equals_sql(spark, name):
    assert compare(spark, oracle(SF), name, QUERIES[name], ORACLES[name], SF) == []


# ---- fill in the middle


def plain_form(text, doc_id):
    tokens = TOKEN.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), out


def odd_texts():
    r = random.Random(9)
    shared = "".join(r.choice(["alpha ", "be\tta", "\n", "gammaé ", "日本", " ", "<P", "S>"]) for _ in range(4000))
    for i in range(60):
        yield "".join(r.choice(["x", " ", "\n", "é", "\U0001f600", " ", "word "]) for _ in range(r.randint(0, 40)))
        yield shared[i : r.randint(0, len(shared))] + " " * r.randint(0, 3)
        yield "a" * r.randint(0, 30000) + shared + "日" * r.randint(0, 9000)
        yield " " * r.randint(0, 20000) + "end" + "\n" * r.randint(0, 9000)


def test_cuts_at_every_token():
    known = fim.Summaries(most=50_000)
    for text in odd_texts():
        raw, tokens = text.encode(), TOKEN.findall(text)
        for _ in range(2):  # the second time from remembered chunks
            cuts = fim.Cuts(raw, known)
            assert cuts.n == len(tokens)
            step = max(1, cuts.n // 50)
            for k in {*range(0, cuts.n + 1, step), cuts.n}:
                head = "".join(tokens[:k])
                assert cuts.end_of(k) == (len(head.encode()), len(head))


def test_chunks_follow_content():
    r = random.Random(2)
    body = bytes(r.choice(b"abcdefgh \n") for _ in range(60_000))

    def chunks(t):
        at = fim.bounds(np.frombuffer(t, np.uint8))
        return {t[a:b] for a, b in zip(at, at[1:])}

    one, two = chunks(body), chunks(b"something else in front " + body)
    assert len(one & two) >= 0.8 * len(one) and len(one) > 20
    sizes = [len(c) for c in one]
    assert max(sizes) <= fim.MOST and sorted(sizes)[1] >= fim.LEAST


def test_fill_in_middle_rows(spark, tmp_path):
    rows = [*ROWS, *[(100 + i, t, "en", "z", 0) for i, t in enumerate(odd_texts())], (90, "a <M> b", "en", "z", 0), (91, "a < P> <P", "en", "z", 0)]
    path = folder(spark, tmp_path / "a", rows, [])
    got = QUERIES["op12_fill_in_middle"](spark, path).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        n, form, p, m, out = plain_form(text or "", doc_id)
        want.append((doc_id, n, form, p, m, digest(out), digest(text or "")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("fim", F.lit("mine")).withColumn("n", F.lit("x"))
    kept = fim.fill_in_middle(docs, out="made")
    assert kept.columns == [*docs.columns, "made"] and kept.where("fim = 'mine' and n = 'x'").count() == len(rows)
    assert QUERIES["op12_fill_in_middle"](spark, folder(spark, tmp_path / "b", [], [])).count() == 0


# ---- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> rows of the query."""
    of = {}
    for d, text, lang, source, n in rows:
        of.setdefault(source, []).append(((d is not None, d or 0), plain_leaf((d, source, lang, n, text)), d, text, lang, n))
    order = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(of[s], key=lambda x: x[:2]), None) for s in order}
    trees = {s: (x, plain_tree([y[1] for y in x])) for s, (x, _) in trees.items()}
    top = plain_tree([trees[s][1][-1][0] for s in order])
    for g, s in enumerate(order):
        members, levels = trees[s]
        for i, (_, leaf, d, text, lang, n) in enumerate(members):
            path = plain_path(levels, i) + plain_path(top, g)
            now = leaf
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and text is not None:
                now = plain_leaf((d, s, lang, n, text.replace("\n", "")))
            for left, right in path:
                now = h(*left, now, *right)
            yield d, leaf, levels[-1][0], top[-1][0], h(*[x for left, right in path for x in (*left, *right)]), now, now == top[-1][0]


def test_van_emde_boas_addresses():
    for height in range(8):
        total = (3 ** (height + 1) - 1) // 2
        seen = [a for level in range(height + 1) for a in merkle.level_addresses(height, level)]
        assert sorted(seen) == list(range(total))

    def laid_out(root, levels):  # the layout by its definition: (depth, number) in order
        if levels == 1:
            return [root]
        upper = levels // 2
        out = laid_out(root, upper)
        for i in range(3**upper):
            out += laid_out((root[0] + upper, root[1] * 3**upper + i), levels - upper)
        return out

    order = laid_out((0, 0), 7)
    assert all(merkle.level_addresses(6, 6 - depth)[number] == at for at, (depth, number) in enumerate(order))


def test_manifest_rows(spark, tmp_path, monkeypatch):
    many = [(i, f"t\n{i}", "en", "hot", i) for i in range(1000, 3600)] + [(i, "x", None, s, None) for i, s in enumerate(["\U0001f600", "￮", "B", "a", "é"])]
    rows = [*ROWS, *many]
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, folder(spark, tmp_path / "a", rows, [])).collect()]
    want = list(plain_manifest(rows))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {w[-1] for w in want} == {True, False}
    assert QUERIES["op13_merkle_manifest"](spark, folder(spark, tmp_path / "b", [], [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 83, 244])
def test_sizes_over_many_tables(spark, monkeypatch, n):
    """With blocks of 9 leaves the tree needs up to three tables of blocks."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    rows = [("one", i, leaf) for i, leaf in enumerate(leaves)] + [(None, 5, b"\x01" * 32)]
    m = merkle.manifest(spark.createDataFrame(rows, "g string, id long, leaf binary"))
    found = {(r.id, bytes(r.leaf)): r for r in merkle.checked(merkle.proofs(m, "id long, leaf binary"), "leaf").collect()}
    levels = plain_tree([x.hex() for x in leaves])
    top = plain_tree([(b"\x01" * 32).hex(), levels[-1][0]])
    assert len(found) == n + 1
    for i, leaf in enumerate(leaves):
        r = found[i, leaf]
        path = plain_path(levels, i) + plain_path(top, 1)
        assert bytes(r.proof).hex() == "".join(x for left, right in path for x in (*left, *right))
        assert r.root.hex() == r.folded.hex() == top[-1][0] and r.subroot.hex() == levels[-1][0]


# ---- vector-approximation file


def plain_top(rows, k=5, every=50):
    """rows: (id, list of whole numbers)."""
    width = max(map(len, (v for _, v in rows)), default=0)
    padded = [(i, [*v, *[0] * (width - len(v))]) for i, v in rows]
    for at, (i, q) in enumerate(padded):
        if i is not None and i % every == 0:
            scores = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(padded) if b != at]
            for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1):
                yield i, rank, None if none else j, -s


def embedded(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "'x' as node", "2 as id").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_vectors_odd(spark, tmp_path):
    r = random.Random(4)
    vec = lambda: [r.gauss(0, 0.3) for _ in range(8)]
    same = vec()
    rows = [(i, vec()) for i in range(0, 300)]
    rows += [(i, same) for i in range(300, 420)]  # many equal vectors, three of them queries
    rows += [(400, vec()), (400, same), (None, same), (None, vec()), (500, None), (550, [1.0, None, 2.0]), (600, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7)]
    rows += [(700, [0.5, 0.25]), (701, []), (750, [0.0] * 8)]
    got = [tuple(x) for x in QUERIES["op11_vector_approximation"](spark, embedded(spark, tmp_path / "a", rows)).collect()]
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_top(whole)))
    for name, few in (("b", []), ("c", [(0, vec())]), ("d", [(0, vec()), (1, vec()), (3, None)]), ("e", [(1, vec())]), ("f", [(50, None)])):
        got = [tuple(x) for x in QUERIES["op11_vector_approximation"](spark, embedded(spark, tmp_path / name, few)).collect()]
        whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in few if v is not None]
        assert sorted(got) == sorted(plain_top(whole))


def test_small_blocks_and_coarse_cells(spark):
    """Any grid and any blocks give the exact result; large numbers too."""
    r = random.Random(6)
    rows = [(i, [r.choice([-1e15, 1e15, 3e17, -7.0, 2.5, r.gauss(0, 1e6)]) for _ in range(5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = [(i, [limit(int(np.floor(256 * x))) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-limit(sum(x * y for x, y in zip(q, v))), j) for j, v in whole if j != i)
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:5], 1)]
    small = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(400)]
    frame = spark.createDataFrame(small, "vec_id long, embedding array<double>")
    for how in (dict(cells=2, sample=10, block_rows=70, query_rows=3), dict(cells=256, sample=0)):
        got = [tuple(x) for x in vafile.top_k(frame, F.col("vec_id") % 50 == 0, **how).collect()]
        assert sorted(got) == sorted(plain_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in small]))
    got = [tuple(x) for x in vafile.top_k(df, F.col("vec_id") % 50 == 0, cells=4).collect()]
    assert sorted(got) == sorted(want)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, queries = rng.integers(-300, 300, (500, 6)), rng.integers(-300, 300, (40, 6))
    grid = vafile.Grid(vectors[:50], vectors.min(axis=0).astype(float), vectors.max(axis=0).astype(float), 8)
    low, high = grid.bounds(queries, grid.codes(vectors))
    exact = queries @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()


def test_likeness_is_the_share_among_the_smallest_hashes():
    import random

    import numpy as np

    from fieldtally.llm import phrases

    r = random.Random(5)
    for na, nb in ((0, 0), (0, 3), (5, 0), (1, 1), (40, 64), (64, 64), (64, 7)):
        a = np.array(sorted(r.sample(range(90), na)), np.uint32)
        b = np.array(sorted(r.sample(range(90), nb)), np.uint32)
        both = np.union1d(a, b)[: phrases.HASHES]
        want = float(np.count_nonzero(np.isin(both, a) & np.isin(both, b)) / len(both)) if len(both) else 1.0
        assert phrases.likeness(a, b) == want
