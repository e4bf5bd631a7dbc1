"""The trees of the PII operator: what they see, what they learn, what the thresholds reject."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import pii
from fieldtally.session import store

WORDS = "ba ce di fo gu hara jelo kimu nopre quas".split()


def luhn_ok(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number[::-1])) % 10 == 0


def made():
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    number = lambda: "4" + "".join(r.choice("0123456789") for _ in range(15))

    def card(good=True):
        while luhn_ok(n := number()) != good:
            pass
        return n

    texts = []
    for i in range(400):
        texts.append(f"{prose(6)} {card()} {prose(4)}")  # in prose: cards
        texts.append(f"{prose(3)} #{number()}; {prose(3)}")  # ticket numbers: one in ten passes by chance
        texts.append(f"{prose(4)} password={hashlib.md5(b'%d' % i).hexdigest()} {prose(3)}")
        texts.append(f"{prose(4)} sum {hashlib.md5(b'-%d' % i).hexdigest()} {prose(3)}")
        texts.append(f"{prose(4)} AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} {prose(3)}")
        texts.append(f"{prose(3)} +1 ({r.randint(200, 989)}) 555-{r.randint(1000, 9999)} {prose(3)}")
    probes = {
        "prose": f"{prose(6)} {card()} {card()} {prose(4)}",  # side by side: the base pattern takes both as one and drops them
        "beside": f"{prose(3)} +1 (269) 555-3296 {card()} {prose(3)}",
        "unknown": f"{prose(4)} passcode={hashlib.md5(b'probe').hexdigest()} {prose(3)}",
        "sum": f"{prose(4)} sum {hashlib.md5(b'other').hexdigest()} {prose(3)}",
        "at": f"{prose(4)} bo.lim (at) post [dot] example.org {prose(3)}",
    }
    return texts, probes, card


@pytest.fixture(scope="module")
def judged(spark):
    texts, probes, card = made()
    rows = list(enumerate(texts)) + [(-1 - i, t) for i, t in enumerate(probes.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wide = pii.candidates(df, "text")
    stored = store(wide.select("doc_id", "_base", "_cands", F.monotonically_increasing_id().alias("_row")), "test-pii")
    found, model, thresholds = pii.scored(stored, pii.Fit())
    found = found.join(stored.select(F.col("_row").alias("row"), "doc_id"), "row")
    spans = {r.doc_id: r.s for r in pii.added(stored, pii.Fit()).select("doc_id", pii.listed("_spans").alias("s")).collect()}
    names = [c for c in found.columns if c.startswith("f_")]
    weights = dict(zip(names, model.featureImportances.toArray()))
    scores = [r.asDict() for r in found.select("doc_id", "kind", "start", "end", "value", "checks", "label", "score").collect()]
    return texts, probes, scores, thresholds, weights, spans


def at(probes, name):
    return -1 - list(probes).index(name)


def test_no_check_is_an_input_and_several_inputs_count(judged):
    weights = judged[4]
    assert not {"f_checks", "f_luhn", "f_octets", "f_named", "f_plus", "f_at"} & set(weights)
    assert sum(w > 0.01 for w in weights.values()) >= 4 and max(weights.values()) < 0.9


def test_one_format_in_two_contexts_scores_apart(judged):
    _, probes, scores, thresholds, _, spans = judged
    secret = pii.KINDS.index("secret")
    score = {r["doc_id"]: r["score"] for r in scores if r["kind"] == secret}
    known, bare = score[at(probes, "unknown")], score[at(probes, "sum")]
    assert known > thresholds[secret] > bare
    # the name is not in the list: the trees have found it
    assert "secret:" in spans[at(probes, "unknown")] and "secret:" not in spans[at(probes, "sum")]


def test_thresholds_reject_numbers_that_pass_by_chance(judged):
    texts, probes, scores, thresholds, _, spans = judged
    card = pii.KINDS.index("card")
    failing = [r["score"] for r in scores if r["kind"] == card and not r["checks"] and "#" in texts[r["doc_id"]]]
    above = sum(x >= thresholds[card] for x in failing)
    assert len(failing) > 300 and above < 0.2 * len(failing)  # 400 cards are right: at 0.98, about 72 failing ones (8 by chance) may stay above
    for name, n in (("prose", 2), ("beside", 1)):
        assert spans[at(probes, name)].count("card:") == n
    assert "phone:" in spans[at(probes, "beside")]


def test_every_candidate_outside_base_spans_is_scored(judged):
    scores = judged[2]
    failing = [r for r in scores if not r["checks"]]
    assert failing and all(0 <= r["score"] <= 1 for r in scores)


def test_disguised_addresses_look_like_plain_ones(spark):
    df = spark.createDataFrame([("bo (at) x [dot] org",), ("+49 30 1234567",), ("bo@x",)], "v string")
    got = [r[0] for r in df.select(pii.plain(F.col("v"))).collect()]
    assert got == ["bo@x.org", "49 30 1234567", "bo@x"]
    assert [r[0] for r in df.select(pii.valid("email", F.col("v"))).collect()] == [True, False, False]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    assert [r.n for r in pii.find_pii(df, keep=("doc_id",)).select(F.size("spans").alias("n")).collect()] == [0, 0]
    assert pii.find_pii(df.limit(0), keep=("doc_id",)).count() == 0


def test_every_answer_is_learnt_from(spark, monkeypatch):
    """More answers than the 20,000 that used to be drawn: all of them reach the trees or the thresholds."""
    n = 24_000
    made_up = spark.range(n).select(
        F.col("id").alias("row"), F.lit(2).alias("kind"), F.lit(0).alias("start"), F.lit(16).alias("end"),
        (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 3 + F.col("id") % 5).cast("double").alias("f_length"),
    )
    kept = {}
    monkeypatch.setattr(pii, "store", lambda df, label: kept.setdefault(label, store(df, label)))
    model, thresholds = pii.fit(made_up, pii.Fit())
    assert model is not None and thresholds
    assert sorted(df.count() for df in kept.values()) == [n]
