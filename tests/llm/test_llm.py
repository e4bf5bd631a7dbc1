"""Every query of the training-data operators against brute force, on given tables, awkward rows and empty tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from fieldtally.llm import bpe, idfiles, lattice, mixing, neardup, phrases, pii, quality, urls
from fieldtally.llm.queries import ORACLES, QUERIES
from tests.compare import compare, oracle

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvz") for _ in range(r.randint(2, 8))) for _ in range(n))


BASE = prose(120, 1)
ROWS = [
    (None, None, "en", None, None), (None, "", "en", None, 0), (1, BASE, "en", "a", 0), (1, BASE, "en", "a", 0), (1, BASE, "en", "a", 0),
    (2, BASE + " end", None, "a", 0), (3, BASE, "en", "b", 0), (4, prose(30000, 2), "de", "b", 0), (5, "one two", "en", "b", 0),
    (6, "Call +1 (988) 555-2485 4111111111111111 or bo.2@mail8.example.com at 10.20.30.40, 300.1.1.1", "en", "c", 0),
    (7, "é日本 \u00a0x\n\nx\n\nx\t  y 😀 it's 12'll", "fr", "c", 0), (8, "x" * 5000, "en", "c", 0), (9, "ha " * 400, "en", "c", 0),
    (10, prose(200, 3) + ' token = "0641917ea4e9feb9cda834aa"', "en", "a", 0), (11, "   \n  ", "en", "b", 0), (2, prose(60, 4), "en", None, 0),
]
URLS = ["https://A.Example.NET/en/x?q#f", "http://net/", "http://net", "x", None, "", "https://m.b.org/fr/1", "http://example.com/de/?a", "http://adult-x.example.com/q", "http://xexample.net/en/", "a://?x", "http://org/de/"]


def folder(spark, path, rows, pages):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 as size", "'x' as kept", "2 as quality", "3 as spans").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), ROWS, URLS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("none"), [], [])


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def both(spark, name, odd):
    """(rows of the query, documents as id -> text) on the given table; then the awkward rows, as lists."""
    return QUERIES[name](spark, SF).collect(), QUERIES[name](spark, odd).collect()


def test_bpe(spark, odd, given):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(t):
        ids = enc.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    rows, strange = both(spark, "op1_byte_bpe", odd)
    texts = {d: t for d, t, _ in given}
    assert all(tuple(r[1:]) == expected(texts[r.doc_id]) for r in rows) and len(rows) == len(texts)
    assert sorted(tuple(r[1:]) for r in strange) == sorted(expected(t) for _, t, *_ in ROWS)
    coder = bpe.coder(path, public_tokenizers.PATTERN)
    pool = list(ranks)
    for _ in range(300):
        t = b"".join(rng.choice(pool) for _ in range(rng.randint(1, 9))).decode("utf-8", "replace")
        assert list(memoryview(coder.encode(t)).cast("I")) == enc.encode_ordinary(t)


def test_shards(spark, odd, given):
    rows, strange = both(spark, "op2_vector_shards", odd)
    for got, docs in ((rows, [(d, t) for d, t, _ in given]), (strange, [(d, t) for d, t, *_ in ROWS])):
        want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 8 and r.grown_shard is None for r in got)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.05 * min(sizes.values())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for k, (n, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": n != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[n]:
                out.append((m.start(), k, n, m.end()))
    return [f"{n}:{s}:{e}" for s, k, n, e in sorted(out)]


def test_pii(spark, odd, given):
    rows, strange = both(spark, "op3_pii_spans", odd)
    texts = {d: t for d, t, _ in given}
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_card == sum(x.startswith("card") for x in want)
    assert sorted(r.base_sha256 for r in strange) == sorted(hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest() for _, t, *_ in ROWS)


def test_pii_patterns_on_noise(spark):
    noise = ["".join(rng.choice("ab1. -+@()9_%é") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    got = pii.find_pii(df, keep=("doc_id",)).select("doc_id", pii.listed("base").alias("b")).collect()
    assert all(r.b == ",".join(base_spans(noise[r.doc_id])) for r in got)


def test_pii_adds_a_card_beside_a_phone_and_secrets(spark):
    def card(k):
        d = [int(c) for c in f"4{k:014d}"]
        s = sum(sum(divmod(x * (2 - i % 2), 10)) for i, x in enumerate(d[::-1]))
        return f"4{k:014d}{-s % 10}"

    texts = [f"{prose(8, i)} {card(i * 7919)} {prose(5, i)} +1 ({200 + i % 700}) 555-{1000 + i} {prose(3, i)} {4000000000000000 + i * 31337} x" for i in range(200)]
    texts += [f'{prose(9, i)} token = "{hashlib.md5(str(i).encode()).hexdigest()}" x {hashlib.md5(str(-i).encode()).hexdigest()}' for i in range(100)]
    texts.append(f"ouin +1 (269) 555-3296 {card(12345)} and")
    texts.append(prose(300, 77))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = {x.doc_id: x.s for x in pii.find_pii(df, keep=("doc_id",)).select("doc_id", pii.listed("spans").alias("s")).collect()}
    at = texts[300].index("4000000") if "4000000" in texts[300] else texts[300].index("4")
    assert f"card:{at}:{at + 16}" in r[300]
    assert sum("secret" in r[i] for i in range(200, 300)) > 90
    out = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert out[301] == texts[301] and "[CARD]" in out[300]


def test_quality(spark, odd, given):
    rows, strange = both(spark, "op4_quality_rules", odd)

    def counts(t):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = collections.Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    texts = {d: t for d, t, _ in given}
    assert all(tuple(r[1:7]) == counts(texts[r.doc_id]) for r in rows)
    assert sorted(tuple(r[1:7]) for r in strange) == sorted(counts(t or "") for _, t, *_ in ROWS)
    assert not any(r.kept and r.base_failed for r in rows)
    noise = random.Random(1).randbytes(3000).hex()
    packer = __import__("zstandard").ZstdCompressor()
    assert quality.judge(prose(400, 9) + " " + prose(300, 8), quality.Rules(), quality.Bands(whole=((float("inf"), 0.1, 0.9),), chunk=(0.1, 0.9)), packer)[-1]
    assert not quality.judge(" ".join("ab cd ef gh ij kl mn op qr st" for _ in range(300)), quality.Rules(repeat_percent=100), quality.Bands(), packer)[-1]
    assert not quality.judge(" ".join(base64.b85encode(random.Random(2).randbytes(40)).decode() for _ in range(80)), quality.Rules(), quality.Bands(), packer)[-1] and noise


def test_phrases(spark, odd, empty, given):
    rows, strange = both(spark, "op5_phrase_fingerprints", odd)
    docs = sorted((d, t) for d, t, _ in given)
    got = {r.doc_id: r for r in rows}
    for i, (d, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = map(phrases.fingerprint, (t, e, n))
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (phrases.as_text(a), phrases.as_text(b))
        assert (got[d].near_edited, got[d].near_next) == (phrases.likeness(a, b), phrases.likeness(a, c))
    assert sorted(r.fingerprint for r in strange) == sorted(phrases.as_text(phrases.fingerprint(t or "")) for _, t, *_ in ROWS)
    seen: set = set()
    phrases.parse(b"aababcabcd", seen)
    assert seen == {b"a", b"ab", b"abc", b"abcd"}


def near_classes(docs):
    """Brute force: all pairs with a common shingle."""
    sh = neardup.Shingler(5)
    parts = [sh(t or "") for _, t in docs]
    index, up = collections.defaultdict(list), list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (h, _) in enumerate(parts):
        for k in h.tolist():
            index[k].append(i)
    for a, b in {(x, y) for v in index.values() for x in v for y in v if x < y}:
        if neardup.similarity(parts[a], parts[b]) >= 0.8:
            up[top(a)] = top(b)
    first = {}
    for i, (_, t) in enumerate(docs):
        up[top(i)] = top(first.setdefault(t or "", i))
    out = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        out[top(i)].append(str(d))
    return sorted(sorted(v) for v in out.values())


def classes_of(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.class_id].append(str(r.doc_id))
    return sorted(sorted(v) for v in out.values())


def test_near_duplicates(spark, odd, given):
    rows, strange = both(spark, "op6_near_duplicates", odd)
    docs = [(d, t) for d, t, _ in given]
    assert classes_of(rows) == near_classes(docs)
    assert len(strange) == len(ROWS)
    one = {r.class_id for r in strange if r.doc_id in (1, 3)}
    assert one == {1}
    kept = neardup.one_of_each(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    assert sorted(str(r.doc_id) for r in kept).count("1") == 1 and len(kept) == len(near_classes([(i, t) for i, (_, t, *_) in enumerate(ROWS)]))
    a = (np.arange(1, 301, dtype=np.uint64), np.arange(1, 301) % 3 + 1.0)
    b = (a[0][:250], a[1][:250])
    agree = np.mean(neardup.signature(*a, 4000) == neardup.signature(*b, 4000))
    assert abs(agree - neardup.similarity(a, b)) < 0.03


def test_near_duplicates_in_one_large_family(spark):
    base = prose(300, 42).split(" ")
    docs = []
    for i in range(150):
        r = random.Random(i)
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert classes_of(neardup.class_ids(*neardup.near_duplicates(df)).collect()) == near_classes(docs)


def test_lattice(spark, odd, given):
    rows, strange = both(spark, "op7_lattice_scores", odd)
    for got, docs in ((rows, [(d, t) for d, t, _ in given]), (strange, [(d, t) for d, t, *_ in ROWS])):
        words = {id(x): WORD.findall((x[1] or "").translate(lattice._LOWER)) for x in docs}
        train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
        c = collections.Counter(w for x in docs if train(x[0]) for w in words[id(x)])
        ends = sum(train(x[0]) for x in docs)
        n, v = sum(c.values()) + ends, len(c) + (ends > 0)
        base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
        want = sorted((str(x[0]), not train(x[0]), len(words[id(x)]) + 1, sum(c[w] > 0 for w in words[id(x)]) + (ends > 0), n) for x in docs)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
        scores = sorted(sum(map(base, words[id(x)])) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1))) for x in docs)
        assert sorted(r.base_score for r in got) == pytest.approx(scores)
        assert all(r.score < 0 for r in got)


def test_lattice_sums_all_segmentations():
    pieces, byte = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    one = lattice.normalised(pieces, byte, 0)
    many = lattice.Lattices(one)

    def brute(s):
        return sum(math.exp(one.pieces[s[:i]]) * brute(s[i:]) for i in range(1, len(s) + 1) if s[:i] in one.pieces) if s else 1.0

    words = ["the", "thering", "osadoie", "x" * 70, "日本語", "😀a", "", "a\0b"]
    scores = many.log_probabilities(words)
    for w, s in zip(words, scores):
        assert s == pytest.approx(one.log_probability(w))
    for w in words[:3]:
        assert one.log_probability(w) == pytest.approx(math.log(brute(lattice.SPACE + w)))
    single, into, others = collections.defaultdict(float), np.zeros(len(many.names)), collections.defaultdict(float)
    for w in words:
        one.expect(w, 2, single)
    many.expect(words, [2] * len(words), into, others)
    for i in np.flatnonzero(into):
        others[many.names[i]] += into[i]
    assert set(single) == set(others) and all(single[k] == pytest.approx(others[k]) for k in single)


def test_id_files(spark, odd, given):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    rows, strange = both(spark, "op8_id_files", odd)
    got, start = {r.doc_id: r for r in rows}, 0
    for d, t in sorted((d, t) for d, t, _ in given):
        ids = tk.encode(t, add_special_tokens=False).ids + [2]
        assert tuple(got[d][1:]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    crcs = sorted(zlib.crc32(np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t, *_ in ROWS)
    assert sorted(r.ids_crc32 for r in strange) == crcs
    ends = sorted((r.start, r.n_tokens) for r in strange)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and [r.doc_id for r in sorted(strange, key=lambda r: r.start)][-2:] == [None, None]
    path = idfiles.id_folder(spark)
    m = idfiles.write_ids(spark.read.parquet(f"{SF}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2, rows_per_file=30).orderBy("block").collect()
    first = sorted((d, t) for d, t, _ in given)
    assert len(m) > 3
    for k in (0, 1, m[0].n_docs - 1):
        assert idfiles.read_one(path, m[0].file, k).tolist() == tk.encode(first[k][1], add_special_tokens=False).ids + [2]


def fair(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in fixed)
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in names if x not in fixed)) for s in names if s not in fixed}
        over = {s for s in share if share[s] > most * sizes[s]}
        if not over:
            return {**{s: float(most * sizes[s]) for s in fixed}, **share}
        fixed |= over


def test_mix(spark, odd, given):
    rows, strange = both(spark, "op9_pivotal_mix", odd)
    for got, docs in ((rows, given), (strange, [(d, t, s) for d, t, _, s, _ in ROWS])):
        size = collections.Counter()
        for _, t, s in docs:
            size[s] += len(WORD.findall(t or ""))
        want, taken = fair(dict(size)), collections.Counter()
        for r in got:
            assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
            assert r.copies in (math.floor(want[r.source] / max(1, size[r.source])), math.floor(want[r.source] / max(1, size[r.source])) + 1)
            taken[r.source] += r.taken
        assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(WORD.findall(t or ""))) for d, t, _ in docs)
        for s in size:
            largest = max(len(WORD.findall(t or "")) for _, t, x in docs if x == s)
            assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op9_pivotal_mix"](spark, SF).collect()))
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert mixing.copied(docs, mixing.mix(docs)).count() == sum(r.copies for r in strange)


def test_urls(spark, odd):
    con = oracle(SF)
    assert not compare(spark, con, "op10_url_trie", QUERIES["op10_url_trie"], ORACLES["op10_url_trie"], SF)
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["op10_url_trie"](spark, odd).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("net", "/", "net/", "block")
    assert got[2] == ("net", "", None, "allow") and got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/fr/", "allow") and got[7][1:] == ("/de/", "example.com/de/", "block") and got[8][2:] == (None, "block") and got[9][2] == "net/"
    top = urls.trie([("allow", "a.b", "/x/yz"), ("block", "a.b", "/x/"), ("block", "b", "/")])
    assert [urls.lookup(top, "c.a.b", p).name for p in ("/x/yzz/k", "/x/y", "/q")] == ["a.b/x/yz", "a.b/x/", "b/"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == columns
        rows = pd.DataFrame(out.collect(), columns=columns)
        if name == "quality":
            assert BASE in set(rows.text) and not rows.text.isin(["one two", "ha " * 400]).any()
        if name == "near_duplicates":
            assert (rows.text == BASE).sum() + (rows.text == BASE + " end").sum() == 1
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect()
    assert sorted(r.decoded_sha256 for r in last) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in rows.text)
    assert sorted(map(str, corpus_pipeline.run(spark, odd).collect())) == sorted(map(str, last))
