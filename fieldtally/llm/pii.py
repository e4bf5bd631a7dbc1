"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Base spans come from one pattern a kind (leftmost, non-overlapping) and a check of what was matched: parts of an
address, Luhn's sum, number of digits.  They always stay.  What the patterns miss is where two numbers stand side by
side and are matched as one, a number is written in another way, or a secret follows its name.  For that, generators
with high recall propose spans that may overlap each other and the base ones.  Gradient-boosted trees score them by
format (length, digits, separators) and context (neighbouring characters and words).

What decides an answer is never an input: no check, no word that names a secret, no sign that only base spans have (a
plus, an ``@``; the format is read from the value written plainly).  Answers: right are base spans, and secrets after a
word that names one or of a published key format; look-alikes are candidates whose check fails, those inside a base span of another kind, and long
mixed strings that nothing is assigned to.  A string assigned to an unknown name has no answer; the trees judge it.
All answers are used; a quarter of them, by a hash, is kept out of
training to set each kind's threshold.  Look-alikes are decoys there: a stretch of numbers that holds n failing ones holds
some that pass by chance (``CHANCE``: one for nine with Luhn's sum), so the share of false ones among those that pass is known
without asking the check that made them.  The threshold is the lowest score from which on at least ``precision`` of the
passing ones are right, moved half-way to the next score below that was met (not below 0.5).  A kind without such a score adds nothing.  All candidates outside base spans are scored (:func:`scored`); one is
accepted if it has the form of its kind (the check) and its score reaches the threshold.  Among accepted spans that
overlap, the best score stays; a span that overlaps a base one is not added.

Everything runs on DataFrame expressions and JVM-side trees.  Null text counts as empty and has no spans; rows
with equal or missing ids are told apart by a row number that is written with the candidates.  With no candidates of
either answer (an empty table, say) nothing is learnt and the base spans are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import columns_of, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")

#: The base patterns.  Quantifiers are possessive and a match starts at the beginning of its run (or where the last
#: match ended), which changes no match and keeps the time linear on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, by the kind they propose.
MORE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:@[a-z0-9-]{1,63}+(?!\.[a-z0-9-])|\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[a-z0-9-]{1,63}+){0,4}+)",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\.)\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?(?<![0-9])[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
NAMES_SECRET = r"(?i)(?:pass(?:word|wd|phrase)?|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
#: Published formats of access keys.
KEY_FORMATS = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,})$"
ASSIGNED = r"[=:]\s{0,3}[\"']?$"
NAMES_CONTACT = r"(?i)\b(?:tel|phone|call|mobile|fax|mail|contact|card|visa)\b"

#: Look-alikes that pass their check by chance, for each one that fails it; 1 where no figure is known.
CHANCE = {"card": 1 / 9}

CONTEXT = 24
STEP = 256  # matches of a text are numbered in steps, so many matches do not cost their square


@dataclass(frozen=True)
class Fit:
    precision: float = 0.98
    trees: int = 12
    depth: int = 3


def matches(df: DataFrame, name: str, pattern: str, hint: Column | None = None) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of the pattern's matches, in code points."""
    text = F.col("_text") if hint is None else F.when(hint, F.col("_text")).otherwise(F.lit(""))
    all_of, gaps = f"{name}_m", f"{name}_g"
    df = df.withColumn(all_of, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = F.size(all_of)
    df = df.withColumn(
        gaps,
        F.when(found > 0, F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), found), F.col(all_of), lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"), F.length(v).alias("len")))),
    )
    # sums of whole steps first, then the places inside each step
    steps = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / STEP).cast("int"))
    part = lambda k: F.slice(F.col(gaps), k * STEP + 1, F.lit(STEP))
    total = lambda k: F.aggregate(part(k), F.lit(0), lambda s, x: s + x.gap + x.len)
    before = F.aggregate(steps, F.array(F.lit(0)), lambda acc, k: F.array_append(acc, F.element_at(acc, -1) + total(k)))
    df = df.withColumn(f"{name}_b", F.when(F.size(gaps) > STEP, before).when(F.size(gaps) > 0, F.array(F.lit(0))))
    kind = "array<struct<start:int,end:int,value:string>>"

    def place(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        span = F.struct(start.alias("start"), (start + x.len).alias("end"), x.value.alias("value"))
        return F.struct((start + x.len).alias("at"), F.array_append(acc.out, span).alias("out"))

    inside = lambda k: F.aggregate(part(k), F.struct(F.get(F.col(f"{name}_b"), k).alias("at"), F.array().cast(kind).alias("out")), place, lambda acc: acc.out)
    spans = F.when(F.size(gaps) > 0, F.flatten(F.transform(steps, inside))).otherwise(F.array().cast(kind))
    return df.withColumn(name, spans).drop(all_of, gaps, f"{name}_b")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Is Luhn's sum of the digits a multiple of ten?"""
    figures = F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != "")
    doubled = F.transform(figures, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def octets(value: Column) -> Column:
    """Are the first four numbers at most 255?"""
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def plain(value: Column) -> Column:
    """The value as it is written without disguise: ``bo (at) x [dot] org`` as ``bo@x.org``, numbers without a plus."""
    dots = F.regexp_replace(value, r"(?i)\x20?(?:[(\[]dot[)\]]|\[\.\]|\(\.\))\x20?", ".")
    return F.regexp_replace(F.regexp_replace(dots, r"(?i)\x20?[(\[]at[)\]]\x20?", "@"), r"^\+", "")


def valid(kind: str, value: Column) -> Column:
    """What a match of the kind has to pass."""
    n = F.length(digits(value))
    return {
        "email": plain(value).rlike(r"@[^@]*[.]"), "ip": octets(value), "card": n.between(12, 19) & luhn(value), "phone": n.between(9, 15),
        "secret": (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | value.rlike(KEY_FORMATS),
    }[kind]


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_base`` (kind number, start, end) and ``_cands`` (the same, and what the features need)."""
    df = df.withColumn("_text", text_or_empty(text_col))
    for k, pattern in BASE.items():
        df = matches(df, f"_b_{k}", pattern, F.contains("_text", F.lit(HINTS[k])) if k in HINTS else None)
    odd = F.col("_text").rlike(r"(?i)[(\[]at[)\]]|@")
    for k, pattern in MORE.items():
        df = matches(df, f"_m_{k}", pattern, odd if k == "email" else None)

    def flat(prefix: str, kinds, keep) -> Column:
        def one(k: str) -> Column:
            kept = F.filter(prefix + k, lambda s: keep(k, s))
            return F.transform(kept, lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))

        return F.concat(*map(one, kinds))

    df = df.withColumn("_base", flat("_b_", BASE, lambda k, s: F.lit(True) if k == "email" else valid(k, s.value)))  # its pattern is the whole rule
    # digits of dates and amounts are no candidates; long matches without a check are kept to learn from
    many = lambda k, s: F.length(digits(s.value)) >= 9 if k in ("card", "phone") else F.lit(True)
    all_of = F.array_distinct(F.concat(flat("_b_", BASE, many), flat("_m_", MORE, lambda k, s: valid(k, s.value) if k == "secret" else many(k, s))))
    around = lambda s: F.struct(
        s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"),
        F.substring(F.col("_text"), F.greatest(s.start - CONTEXT, F.lit(0)) + 1, F.least(F.lit(CONTEXT), s.start)).alias("before"),
        F.substring(F.col("_text"), s.end + 1, F.lit(CONTEXT)).alias("after"),
    )
    df = df.withColumn("_all", all_of).withColumn("_cands", F.transform("_all", around))
    df = df.withColumn("_base", F.transform("_base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))))
    return df.drop("_all", "_text", *[f"_b_{k}" for k in BASE], *[f"_m_{k}" for k in MORE])


def features(cands: DataFrame) -> DataFrame:
    """Adds what the trees see of each candidate (``f_`` columns: format and context), whether it has the form of its kind
    (``checks``), and the answer, where there is one (``label``)."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    checks = F.lit(False)
    for i, k in enumerate(KINDS):
        checks = F.when(F.col("kind") == i, valid(k, v)).otherwise(checks)
    form = plain(v)
    n_digits = F.length(digits(form))
    letter = F.length(F.regexp_replace(form, "[^A-Za-z]", ""))
    last, following = F.substring(before, -1, 1), F.substring(after, 1, 1)
    run = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 1))
    longest = F.coalesce(F.array_max(F.transform(F.split(form, "[^0-9]+"), F.length)), F.lit(0))
    changes = F.length(F.regexp_replace(form, r"[0-9]++|[A-Za-z]++|[^0-9A-Za-z]++", "x"))
    cols = {
        **{f"is_{k}": F.col("kind") == i for i, k in enumerate(KINDS)},
        "length": F.length(form), "digits": n_digits, "letters": letter, "others": F.length(form) - n_digits - letter,
        "longest_number": longest, "changes": changes, "upper": F.length(F.regexp_replace(form, "[^A-Z]", "")), "kinds_of_char": F.size(F.array_distinct(F.split(form, ""))),
        "hex": ~form.rlike("[^0-9a-fA-F]"),
        "before_digit": last.rlike("[0-9]"), "before_letter": last.rlike(r"\p{L}"), "before_space": last.rlike(r"\s"), "before_quote": last.rlike("[\"']"),
        "after_digit": following.rlike("[0-9]"), "after_letter": following.rlike(r"\p{L}"), "after_space": following.rlike(r"\s"), "after_quote": following.rlike("[\"']"),
        "assigned": before.rlike(ASSIGNED), "contact": before.rlike(NAMES_CONTACT),
        "word_before": run(before, r"(\p{L}*)[^\p{L}]*$"), "word_after": run(after, r"^[^\p{L}]*(\p{L}*)"),
        "marks_around": F.length(F.regexp_replace(F.concat(before, after), r"[\p{L}\p{N}\s]", "")), "digits_around": F.length(digits(F.concat(before, after))),
    }
    secret = F.col("kind") == KINDS.index("secret")
    of_secret = F.when(before.rlike(NAMES_SECRET) | v.rlike(KEY_FORMATS), F.lit(1.0)).when(~before.rlike(ASSIGNED), F.lit(0.0))
    label = F.when(secret, of_secret).when(F.col("in_base"), F.lit(1.0)).when(~checks | F.col("in_other"), F.lit(0.0))
    return cands.select("*", checks.alias("checks"), label.alias("label"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in cols.items()])


def fit(rows: DataFrame, how: Fit, seed: int = 3):
    """(model or None, threshold by kind number) from the rows with an answer."""
    known = rows.where("label is not null")
    order = F.xxhash64("row", "kind", "start", "end", F.lit(seed))
    inputs = [c for c in rows.columns if c.startswith("f_")]
    # in the order of the hashes, so that sums do not depend on how the rows were dealt
    answers = store(known.select(*inputs, "label", "kind", order.alias("o")).orderBy("o"), "pii-answers")
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(answers)
    held = F.pmod(F.col("o"), F.lit(4)) == 0
    if assembled.where(~held).agg(F.countDistinct("label")).first()[0] < 2:
        return None, {}
    gbt = GBTClassifier(maxIter=how.trees, maxDepth=how.depth, seed=seed, maxBins=32)
    model = gbt.fit(assembled.where(~held))
    scored = model.transform(assembled.where(held)).select("kind", "label", F.floor(vector_to_array("probability")[1] * 200).alias("bin"))
    # 201 score steps a kind: a small table whatever the data
    table = scored.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()
    thresholds: dict[int, float] = {}
    for kind in {r.kind for r in table}:
        right = wrong = 0.0
        bins = sorted((r for r in table if r.kind == kind), key=lambda r: -r.bin)
        for r, below in zip(bins, [r.bin for r in bins[1:]] + [0]):
            right, wrong = right + r.right, wrong + r["all"] - r.right
            if r.right and CHANCE.get(KINDS[kind], 1.0) * wrong <= (1 - how.precision) * right:
                # half-way to the next score that was met, but not below even odds for that
                thresholds[kind] = min(r.bin, max(100, (r.bin + below) / 2)) / 200
    return model, thresholds


def overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def find_pii(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), how: Fit = Fit()) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``: arrays of (start, kind, end), ascending; kind counts along KINDS.

    A row for each row of ``df``.  Only rows with candidates pass a shuffle, without their text.
    """
    wide = candidates(df.select(*keep, *([] if text_col in keep else [text_col])), text_col)
    rows = store(wide.select(*keep, F.col("_base"), F.col("_cands"), F.monotonically_increasing_id().alias("_row")), "pii-rows")
    return added(rows, how).select(*keep, F.col("_fixed").alias("base"), F.col("_spans").alias("spans"))


def scored(rows: DataFrame, how: Fit):
    """Stored rows (``_row``, ``_base``, ``_cands``) -> every candidate outside base spans with its ``score``, the model, the
    threshold by kind number; (None, None, {}) if there is nothing to learn from."""
    meets = lambda b: (b.start < F.col("c.end")) & (F.col("c.start") < b.end)
    same = lambda b: (b.kind == F.col("c.kind")) & (b.start == F.col("c.start")) & (b.end == F.col("c.end"))
    exploded = rows.select(F.col("_row").alias("row"), "_base", F.explode("_cands").alias("c")).select(
        "row", "c.*", F.exists("_base", same).alias("in_base"), F.exists("_base", meets).alias("over_base"), F.exists("_base", lambda b: meets(b) & (b.kind != F.col("c.kind"))).alias("in_other"),
    )
    made = features(exploded)
    model, thresholds = fit(made, how)
    if model is None:
        return None, None, {}
    ready = VectorAssembler(inputCols=[c for c in made.columns if c.startswith("f_")], outputCol="features").transform(made.where(~F.col("over_base")))
    return model.transform(ready).withColumn("score", vector_to_array("probability")[1]), model, thresholds


def added(rows: DataFrame, how: Fit) -> DataFrame:
    """Stored rows (``_row``, ``_base``, ``_cands``, others) -> ``_row``, the others, ``_fixed`` (base spans), ``_spans``."""
    as_spans = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    others = [c for c in rows.columns if c not in ("_base", "_cands")]
    found, _, thresholds = scored(rows, how)
    if not thresholds:
        return rows.select(*others, as_spans(F.col("_base")).alias("_fixed"), as_spans(F.col("_base")).alias("_spans"))
    least = F.lit(2.0)
    for kind, t in thresholds.items():
        least = F.when(F.col("kind") == kind, F.lit(t)).otherwise(least)
    scored_ones = found.where("checks")
    chosen = scored_ones.where(F.col("score") >= least).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("score", "start", "kind", "end")).alias("_more"))
    better = lambda y, x: overlap(y, x) & (
        F.struct(y.score, y.end - y.start, -y.start, -y.kind) > F.struct(x.score, x.end - x.start, -x.start, -x.kind)
    )
    best = F.filter("_more", lambda x: ~F.exists("_more", lambda y: better(y, x)))
    joined = rows.join(chosen, "_row", "left")
    return joined.select(
        *others, as_spans(F.col("_base")).alias("_fixed"),
        as_spans(F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.concat("_base", F.transform(best, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))))).alias("_spans"),
    )


def n_of(spans: str, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s.kind == KINDS.index(kind))).cast("long")


def listed(spans: Column | str) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        new = F.struct(s.end.alias("at"), F.concat(acc.out, F.array(gap, F.get(names, s.kind))).alias("out"))
        longer = F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))
        return F.when((s.start >= acc.at), new).otherwise(longer)

    done = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def redact(df: DataFrame, text_col: str = "text", how: Fit = Fit()) -> DataFrame:
    """``df`` with personal data replaced in ``text_col``; all other columns, and texts without any, stay.

    The patterns run once: every row is written with its candidates, and both the rows without any and the others are
    read from there.  Other columns travel inside one struct, so their names cannot clash with anything here.
    """
    names = df.columns
    others = df.drop(text_col).columns
    given = F.struct(F.lit(True).alias("none"), *[c.alias(f"c{i}") for i, c in enumerate(columns_of(df.drop(text_col)))])
    wide = candidates(df.select(given.alias("given"), F.col(text_col).alias("text")), "text")
    rows = store(wide.withColumn("_row", F.monotonically_increasing_id()), "pii-rows")
    some = F.size("_cands") + F.size("_base") > 0

    def back(found: DataFrame, text: Column) -> DataFrame:
        return found.select(*[F.col(f"given.c{others.index(c)}").alias(c) if c in others else text.alias(c) for c in names])

    return back(rows.where(~some), F.col("text")).unionByName(back(added(rows.where(some), how), redacted(F.col("text"), F.col("_spans"))))
