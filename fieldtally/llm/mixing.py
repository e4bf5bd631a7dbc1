"""Mixing sources to target weights by pivotal dependent rounding.

Every source's target, over its size, is the number of copies each of its documents should have on average;
the whole part is given to all, the fraction is a probability.  Two documents of the same source settle their
fractions against each other: words move from one to the other, in a random direction weighted so that each
document's mean stays what it was, until one of the two has no fraction left.  The other goes on to the
next.  The words of the source never change on the way, so in the end one document per source remains
open, and only it is rounded alone, to the nearer side: a source is off its target by half of it at most.

The pairing runs as a reduction tree.  Blocks of a bounded number of documents are settled by
``aggregate`` over their arrays, what each leaves open goes up to the next level, until a level has one block
per source.  The shortest documents wait: the long one left open at the top settles against all of them taken
as one unit, which moves their common fraction, and then they settle among themselves in a tree of their own, so
that the document open in the end is a short one.  Chance is a hash of document, level and seed, so a rerun gives the same mix, and the order of
rows has no part in it.

Rows that agree in source, id and size are taken as one counted unit, and its copies are dealt to its rows.  Null ids, sources and texts are kept: a null
source is a source like any other, the last; a text without words has size 0 and is never taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import columns_of, free_names, n_words


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> the same with ``target``, in words.

    Weights go round the sources by code point, null last, and share all words; a source stops at ``most``
    times its size, and what is over is shared again by weight.  The sources with the least room for their weight
    stop first, so one pass in that order settles all.  There is a row per source here, not per document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", nth)
    room = F.col("source_size") * float(most) / F.col("weight")
    order = Window.orderBy(room, F.col("n"))
    stopped = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left_words = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(stopped), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(stopped), F.lit(0))
    level = ranked.withColumn("level", F.greatest(left_words / left_weight, F.lit(0.0))).withColumn("room", room)
    # the first source with more room than its share sets the level of all after it
    open_level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "n", "level"))).over(everything)
    return level.withColumn("fit", open_level).select(
        "source", "source_size",
        F.when(
            F.col("fit").isNotNull() & (F.struct("room", "n") >= F.struct("fit.room", "fit.n")), F.col("weight") * F.col("fit.level")
        ).otherwise(F.col("source_size") * float(most)).alias("target"),
    )


def uniform(*what) -> Column:
    """A number inside (0, 1) that depends on ``what`` alone."""
    return (F.pmod(F.xxhash64(*what), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


def pivot(acc: Column, b: Column) -> Column:
    """The open document ``acc.c`` against the next one: one of them is settled, the other stays open.

    ``mass`` is the part of its words that a document's fraction stands for.  Either a takes up x words
    of b, or b takes y of a; the chance of each makes both means stay as they are.
    """
    a = acc.c
    x = F.least(a.words - a.mass, b.mass)
    y = F.least(a.mass, b.words - b.mass)
    up = b.chance * (x + y) < y
    a_settled = F.when(up, x == a.words - a.mass).otherwise(y == a.mass)
    zero = F.lit(0.0)

    def unit(of: Column, mass: Column) -> Column:
        return F.struct(of.doc_id.alias("doc_id"), of.words.alias("words"), of.part.alias("part"), mass.alias("mass"))

    return F.when(
        a_settled,
        F.struct(
            unit(b, F.when(up, b.mass - x).otherwise(b.mass + y)).alias("c"),
            F.array_append(acc.done, unit(a, F.when(up, a.words).otherwise(zero))).alias("done"),
        ),
    ).otherwise(
        F.struct(
            unit(a, F.when(up, a.mass + x).otherwise(a.mass - y)).alias("c"),
            F.array_append(acc.done, unit(b, F.when(up, zero).otherwise(b.words))).alias("done"),
        )
    )


def settle(units: DataFrame, level: int, blocks: Column, seed: int) -> DataFrame:
    """(source, doc_id, words, part, mass) -> the same, settled but for one in each block, marked ``open``."""
    mine = ["source", "doc_id", "words", "part"]
    dealt = units.withColumn("block", F.pmod(F.xxhash64(*mine, F.lit(seed + 3 * level)), blocks))
    member = F.struct(
        F.xxhash64(*mine, F.lit(seed + 3 * level + 1)).alias("order"), "doc_id", "words", "part", "mass",
        uniform(*mine, F.lit(seed + 3 * level + 2)).alias("chance"),
    )
    unit_type = "struct<doc_id:bigint,words:double,part:bigint,mass:double>"
    first = F.struct(F.col("m")[0].doc_id.alias("doc_id"), F.col("m")[0].words.alias("words"), F.col("m")[0].part.alias("part"), F.col("m")[0].mass.alias("mass"))
    start = F.struct(first.cast(unit_type).alias("c"), F.array().cast(f"array<{unit_type}>").alias("done"))
    rest = F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))
    flagged = F.concat(
        F.transform("r.done", lambda u: F.struct(u.doc_id.alias("doc_id"), u.words.alias("words"), u.part.alias("part"), u.mass.alias("mass"), F.lit(False).alias("open"))),
        F.array(F.struct("r.c.doc_id", "r.c.words", "r.c.part", "r.c.mass", F.lit(True).alias("open"))),
    )
    return (
        dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(member)).alias("m"))
        .select("source", F.aggregate(rest, start, pivot).alias("r"))
        .select("source", F.explode(flagged).alias("u")).select("source", "u.*")
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 11, block_units: int = 400) -> DataFrame:
    """(source, doc_id, size, rows, source_size, target, low, extra): a row for each distinct id and size of a source.

    Of its ``rows`` rows, ``extra`` are taken ``low + 1`` times, the others ``low`` times.
    """
    sized = df.select(F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("size"))
    counted = store(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("class", F.floor(F.log2(F.col("size") + 1))), "mix-units")
    # the shortest documents of a source, up to a fifth of its words, are settled last
    classes = counted.groupBy("source", "class").agg(
        F.sum(F.col("size") * F.col("rows")).alias("words"), F.count("*").alias("units"), F.sum((F.col("rows") == 1).cast("long")).alias("single"),
        F.sum(F.when(F.col("rows") == 1, F.col("size")).otherwise(0)).alias("single_words"),
    )
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("class"))
    short = (so_far <= 0.2 * F.sum("words").over(Window.partitionBy("source"))).cast("long")
    by_source = classes.withColumn("short", short).groupBy("source").agg(
        F.sum("words").alias("source_size"), F.max(F.when(F.col("short") == 1, F.col("class")).otherwise(-1)).alias("last_short"),
        F.sum(F.col("short") * F.col("single")).alias("n_short"), F.sum(F.col("units") - F.col("short") * F.col("single")).alias("n_long"),
        F.sum(F.col("short") * F.col("single_words")).alias("short_words"),
    )
    goal = targets(by_source.select("source", "source_size"), most).select(F.col("source").alias("s"), "target")
    sources = store(by_source.join(goal, F.col("source").eqNullSafe(F.col("s"))), "mix-sources").drop("source")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    named = sources.withColumn("low", F.least(F.floor(share), F.lit(most)).cast("long")).withColumn("fraction", share - F.col("low"))
    units = (
        counted.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # of several equal rows, as many as the fraction gives are settled at once; only what is left is drawn
        .withColumn("sure", F.floor(F.col("fraction") * F.col("rows")))
        .withColumn("part", F.col("size")).withColumn("words", F.col("size").cast("double"))
        .withColumn("mass", F.col("words") * (F.col("fraction") * F.col("rows") - F.col("sure")))
        .withColumn("is_short", (F.col("class") <= F.col("last_short")) & (F.col("rows") == 1))
    )

    widest = sources.agg(F.max("n_long"), F.max("n_short")).first()
    long_done, left = reduced(units.where(~F.col("is_short")), named, "n_long", widest[0] or 0, block_units, seed)
    # the long document left open settles against the short ones of its source taken as one
    one = F.struct(F.col("doc_id").alias("doc_id"), F.col("words").alias("words"), F.col("part").alias("part"), F.col("mass").alias("mass"))
    pool = F.struct(
        F.lit(None).cast("long").alias("doc_id"), F.col("short_words").cast("double").alias("words"), F.lit(-1).cast("long").alias("part"),
        (F.col("short_words") * F.col("fraction")).alias("mass"), uniform("s", F.lit(seed + 51)).alias("chance"),
    )
    start = F.struct(one.alias("c"), F.array().cast("array<struct<doc_id:bigint,words:double,part:bigint,mass:double>>").alias("done"))
    met = store(left.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("r", pivot(start, pool)), "mix-met")
    both = met.select("source", F.explode(F.concat(F.array("r.c"), F.col("r.done"))).alias("u")).select("source", "u.*")
    long_left = both.where("part >= 0")
    pools = both.where("part < 0").select(F.col("source").alias("s"), F.when(F.col("words") > 0, F.col("mass") / F.col("words")).otherwise(0.0).alias("new_fraction"))
    short = units.where("is_short").join(pools, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    short = short.withColumn("mass", F.col("words") * F.least(F.greatest(F.coalesce("new_fraction", "fraction"), F.lit(0.0)), F.lit(1.0)))
    short_done, short_left = reduced(short, named, "n_short", widest[1] or 0, block_units, seed + 1000)

    # what is open now is rounded alone, to the nearer side
    last = long_left.unionByName(short_left).withColumn("mass", F.when(F.col("mass") > F.col("words") / 2, F.col("words")).otherwise(0.0))
    drawn = long_done.unionByName(short_done).unionByName(last)
    drawn = drawn.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("part").alias("p"), (F.col("mass") > 0).cast("long").alias("one"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("p"))
    return units.join(drawn, same).select("source", "doc_id", "size", "rows", "source_size", "target", "low", (F.col("sure") + F.col("one")).cast("long").alias("extra"))


def reduced(units: DataFrame, named: DataFrame, count: str, widest: int, block_units: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The reduction tree: (settled units, the one of each source that is still open).  ``count``: units per source."""
    cols = ["source", "doc_id", "words", "part", "mass"]
    blocks, level, settled = F.ceil(F.col(count) / block_units), 0, []
    open_units = units.select(*cols, count)
    while True:
        widest = -(-widest // block_units)
        done = store(settle(open_units, level, F.greatest(blocks, F.lit(1)), seed), f"mix-level-{level}")
        settled.append(done.where(~F.col("open")).select(*cols))
        if widest <= 1:
            break
        open_units = done.where("open").join(named.select("s", count), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        blocks, level = F.ceil(blocks / block_units), level + 1
    everything = settled[0]
    for other in settled[1:]:
        everything = everything.unionByName(other)
    return everything, done.where("open").select(*cols)


def per_row(units: DataFrame, step: int = 1000) -> DataFrame:
    """The units as rows of the table they come from, with ``copies``; many equal rows are dealt out in steps."""
    in_steps = units.withColumn("k", F.explode(F.expr(f"sequence(0L, (rows - 1) div {step})")))
    if (units.agg(F.max("rows")).first()[0] or 0) > step:
        in_steps = in_steps.repartition(F.xxhash64("doc_id", "size", "k"))
    nth = F.explode(F.sequence(F.col("k") * step + 1, F.least(F.col("rows"), (F.col("k") + 1) * step)))
    return in_steps.withColumn("nth", nth).withColumn("copies", F.col("low") + (F.col("nth") <= F.col("extra")).cast("long")).drop("k", "nth")


def copied(df: DataFrame, units: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as often as the mix takes them."""
    names = columns_of(df)
    size, s, d, z, rows, low, extra, copies, k, nth = free_names(df, "size", "s", "d", "z", "rows", "low", "extra", "copies", "k", "nth")
    keyed = df.withColumn(size, n_words(F.col(text_col)))
    u = units.select(*[F.col(a).alias(b) for a, b in (("source", s), ("doc_id", d), ("size", z), ("rows", rows), ("low", low), ("extra", extra))])
    # documents never taken are left out before the texts move
    taken = u.where(F.col(low) + F.col(extra) > 0)
    both = keyed.join(taken, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(size) == F.col(z)) & F.col(source_col).eqNullSafe(F.col(s)))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    out = both.where(F.col(rows) == 1).withColumn(copies, F.col(low) + F.col(extra)).withColumn(nth, times)
    if units.where("rows > 1").limit(1).count():
        order = Window.partitionBy(s, d, z).orderBy(F.xxhash64(text_col))
        many = both.where(F.col(rows) > 1).withColumn(k, F.row_number().over(order)).withColumn(copies, F.col(low) + (F.col(k) <= F.col(extra)).cast("long"))
        out = out.unionByName(many.where(F.col(copies) > 0).drop(k).withColumn(nth, times))
    return out.select(*names)
