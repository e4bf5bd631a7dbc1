"""Near-duplicate classes: ProbMinHash signatures of weighted shingles, banding, verification.

A text's five-word windows, weighted by how often they occur, are the arrivals of Poisson processes: a window of
weight w sends arrivals at rate w, each to a random place of the signature, and a place keeps its earliest arrival.
When the next arrival of every window comes later than all places have seen, nothing can change any more and the
process stops.  Two signatures agree in a place with the probability Jaccard similarity of the weights.

Signatures are cut into bands; texts that agree in a band meet in a bucket.  A bucket may hold a third of the corpus,
so its pairs are never listed.  Instead each member is held against one hub of its bucket (the smallest
text there) by the exact similarity of both texts.  Members that this leaves outside the hub's component go on to the
next round with a hub of their own; ``rounds`` of them settle as many large families a bucket.  What is still open,
members inside the hub's component against those outside and the members that no round settled, is compared by a second
signature of ``places`` places: both sides are cut into blocks of bounded size, a task holds one block of each, and only pairs of different
components whose signatures agree in enough places leave it.  These are checked exactly, the most alike first, and
those that a link found meanwhile has joined are not told at all.  Classes are the connected components of the links.

Equal texts are one node from the beginning (128-bit checksum).  Null text counts as empty; all empty texts are copies
of each other.  A text of fewer than five words has one shingle, its words.  Ids may be null or repeated.  An empty table
has no classes.  Very long texts are shingled whole; a comparison holds two of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import WORD, columns_of, free_names, ship, text_or_empty

_WORD = re.compile(WORD)
_GOLD, _M1, _M2, _BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    KEPT = 150_000

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, ascending; how often each occurs)."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64), np.empty(0)
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        sums = np.full(n, k, np.uint64)
        for i in range(k):
            sums = sums * _BASE + mixed(h[i : i + n] + np.uint64(i))
        items, counts = np.unique(mixed(sums), return_counts=True)
        return items, counts.astype(float)


def signature(items: np.ndarray, weights: np.ndarray, places: int) -> np.ndarray:
    """The shingle that arrives first at each place."""
    first, who = np.full(places, np.inf), np.zeros(places, np.uint64)
    at, turn = np.zeros(len(items)), 0
    while len(items):
        steps = max(1, min(512, 8 * places // len(items)))  # so many arrivals of each shingle at once
        turns = np.arange(turn + 1, turn + steps + 1, dtype=np.uint64)
        turn += steps
        bits = mixed(items[:, None] ^ mixed(turns)[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weights[:, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        place = (((bits * _GOLD) >> np.uint64(33)) % np.uint64(places)).astype(np.int64).ravel()
        early = np.flatnonzero(times.ravel() < first[place])
        early = early[np.argsort(-times.ravel()[early], kind="stable")]  # the earliest is written last
        first[place[early]] = times.ravel()[early]
        who[place[early]] = items[early // steps]
        goes_on = times[:, -1] < first.max()
        items, weights, at = items[goes_on], weights[goes_on], times[goes_on, -1]
    return who


def buckets(who: np.ndarray, bands: int) -> list[int]:
    rows = who.reshape(bands, -1)
    key = mixed(np.arange(bands, dtype=np.uint64))
    for c in range(rows.shape[1]):
        key = mixed(key ^ rows[:, c])
    return key.view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: sum over common d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    # in order of y / x, the larger quotient is that of y from d on and that of x before it
    later_y = np.cumsum(y[::-1])[::-1]
    earlier_x = np.cumsum(x) - x
    parts = (later_y + b[1].sum() - y.sum()) / y + (earlier_x + a[1].sum() - x.sum()) / x
    if parts.min() == parts.max():  # equal counts: whole numbers, rounded once
        return float(len(parts) / parts[0])
    return float((1.0 / parts).sum())


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def signed(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, buckets) of every row."""
    ship(df.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(words)
        for batch in batches:
            ids = batch.column(0)
            nodes, found = [], []
            for text in batch.column(1).to_pylist():
                nodes.append(hashlib.md5(text.encode("utf-8", "replace")).digest())
                items, weights = shingled(text)
                found.append(buckets(signature(items, weights, bands * rows), bands) if len(items) else [])
            columns = [ids, pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "buckets"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return docs.mapInArrow(sign, "doc_id long, node binary, buckets array<long>")


def small_or_shuffled(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored, narrow table is sent to all tasks if it has few rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


#: Far above the rounding errors of a similarity, far below the gap to the next quotient of whole numbers.
SLACK = 1e-9

#: Shingles (16 bytes each) that a task remembers between comparisons.
SHINGLES_HELD = 2_000_000


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b) -> (a, b, sim): exact similarity of the two texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(words)
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # the same texts come up again and again
        held = 0

        def of(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node not in known:
                found = shingled(text)
                if held + len(found[0]) > SHINGLES_HELD:
                    known.clear()
                    held = 0
                known[node] = found
                held += len(found[0])
            return known[node]

        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((a, b, similarity(of(a, ta), of(b, tb))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.binary(), pa.binary(), pa.float64()))], names=["a", "b", "sim"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return store(with_a.select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary, sim double"), "neardup-verified")


def marked(texts: DataFrame, words: int, places: int) -> DataFrame:
    """(node, marks): a second, longer signature, a byte for each place, of texts that the hubs leave open."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingler(words)
        for batch in batches:
            marks = []
            for text in batch.column(1).to_pylist():
                items, weights = shingled(text)
                who = signature(mixed(items + _GOLD), weights, places)  # other arrivals than those of the bands
                marks.append((mixed(who) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["node", "marks"])

    return texts.select("node", "text").mapInArrow(mark, "node binary, marks binary")


def least_agreement(places: int, least: float) -> float:
    """Places agree independently, so fewer than 4.5 standard deviations below the mean come with a chance of 4 in a million."""
    return places * least - 4.5 * (places * least * (1 - least)) ** 0.5


def alike_in_blocks(sides: DataFrame, labels: DataFrame | None, marks: DataFrame, places: int, low: float, top: float, block: int = 256) -> DataFrame:
    """(turn, bucket, node, inner, outer, n_inner, n_outer) -> (a, b, agree): pairs of an inner and an outer member of one
    bucket that lie in different components and whose signatures agree in at least ``low`` and fewer than ``top`` places.

    A side of n members is dealt into n / ``block`` blocks by a hash of the node and sent once to each block of the other
    side, so no task holds more than two blocks of a bucket, and n * m / ``block`` rows are sent, not n * m pairs.
    Two members that meet in several buckets are told once, in the first of them: each row knows all its buckets.
    """
    here = F.struct("turn", "bucket", "inner", "outer", "n_inner", "n_outer")
    nodes = sides.groupBy("node").agg(F.collect_list(here).alias("at")).join(marks, "node")  # signatures and labels are looked up once a node
    if labels is None:
        nodes = nodes.withColumn("label", F.col("node"))
    else:
        nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def met_in(side: str) -> Column:
        return F.transform(F.filter("at", lambda x: x[side]), lambda x: F.xxhash64(x["turn"], x["bucket"]))

    nodes = nodes.select("node", "label", "marks", "at", met_in("inner").alias("ins"), met_in("outer").alias("outs"))
    blocks = {s: F.ceil(F.col(f"n_{s}") / block).cast("int") for s in ("inner", "outer")}

    def dealt(side: str, other: str) -> Column:
        """The block pairs of a member, its own block being fixed."""
        own = F.pmod(F.xxhash64("node", F.lit(7)), blocks[side]).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks[other] - 1), lambda o: F.struct(F.lit(side == "inner").alias("is_inner"), *((own.alias("i"), o.alias("j")) if side == "inner" else (o.alias("i"), own.alias("j")))))
        return F.when(F.col(side), pairs)

    none = F.array().cast("array<struct<is_inner:boolean,i:int,j:int>>")
    told = ["node", "label", "marks", "ins", "outs"]
    rows = nodes.select(*told, F.inline("at"))
    both = (F.col("inner") & F.col("outer")).alias("both")
    rows = rows.select(*told, "turn", "bucket", both, F.inline(F.concat(F.coalesce(dealt("inner", "outer"), none), F.coalesce(dealt("outer", "inner"), none))))
    rows = rows.select(F.xxhash64("turn", "bucket", "i", "j").alias("pair"), F.xxhash64("turn", "bucket").alias("key"), "is_inner", "both", *told)
    parts = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(t: pa.Table) -> pa.RecordBatch:
            key, inner, both = (t.column(c).to_numpy() for c in (1, 2, 3))
            node, label = (np.array(t.column(c).to_pylist(), object) for c in (4, 5))
            seen = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, places)
            within, without = ([frozenset(x) for x in t.column(c).to_pylist()] for c in (7, 8))
            _, label = np.unique(label, return_inverse=True)
            ins, outs = np.flatnonzero(inner), np.flatnonzero(~inner)
            found: list[tuple] = []
            for x in ins:
                ys = outs[(label[outs] != label[x]) & (key[outs] == key[x])]
                if not len(ys):
                    continue
                agree = (seen[ys] == seen[x]).sum(axis=1)
                for y, n in ((y, n) for y, n in zip(ys[agree >= low], agree[agree >= low]) if n < top):
                    if both[x] and node[x] > node[y]:  # each against each: the other way round they meet again
                        continue
                    if key[x] == min((within[x] & without[y]) | (without[x] & within[y])):
                        found.append((min(node[x], node[y]), max(node[x], node[y]), int(n)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 3, (pa.binary(), pa.binary(), pa.int32()))], names=["a", "b", "agree"])

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                yield of(t.slice(lo, hi - lo))
            rest = t.slice(cuts[-1]) if len(t) else None  # the last block pair may go on in the next batch
        if rest is not None:
            yield of(rest)

    met = rows.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(compare, "a binary, b binary, agree int")
    return store(met, "neardup-alike")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of the connected component, for every node with a link."""
    both = store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "neardup-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = store(step.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "neardup-labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components after more links: only the links between different components are followed."""
    if labels is None:
        return None if links.isEmpty() else components(links)
    over = store(ends(links, labels).where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "neardup-over")
    if over.isEmpty():
        return labels
    moved = components(over)
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    new = moved.join(labels.select("node"), "node", "left_anti")
    return store(old.select("node", F.coalesce("to", "label").alias("label")).unionByName(new), "neardup-labels")


def ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components of both ends, la and lb."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return pairs


def labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs that no chain of links joins yet."""
    if labels is None:
        return pairs
    return ends(pairs, labels).where("la <> lb").drop("la", "lb")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bands: int = 40, rows: int = 8, rounds: int = 3, places: int = 640
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, node, a row per row; classes: node, class for every node).  A class is named by a node.

    Two texts of similarity ``least`` = 0.8 meet in a bucket with probability 0.9994 under 40 bands of 8.  Of those that
    the hubs leave open, the second signature passes over 4 in a million.
    """
    least -= SLACK  # exactly ``least`` counts; the triangle bounds below widen with it
    docs = store(signed(df, id_col, text_col, words, bands, rows), "neardup-docs")
    members = docs.select("node", F.explode("buckets").alias("bucket")).distinct()
    # most buckets have one member; these are dropped by a sum, before anything is joined
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    alive = store(members.join(shared, "bucket", "left_semi"), "neardup-members")
    needed = small_or_shuffled(store(alive.select("node").distinct(), "neardup-nodes"))
    whole = df.select(text_or_empty(text_col).alias("text")).withColumn("node", node_of(F.col("text")))
    texts = store(whole.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "neardup-texts")

    labels: DataFrame | None = None
    sides: list[DataFrame] = []  # members inside (inner) and outside (outer) their hub's component, where there are both

    def check(pairs: DataFrame) -> DataFrame:
        nonlocal labels
        found = verified(pairs, texts, words)
        labels = relabelled(labels, found.where(F.col("sim") >= least).select("a", "b"))
        return found

    for turn in range(rounds):
        hubs = alive.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
        held = store(alive.withColumnRenamed("node", "b").join(hubs.select("bucket", "a"), "bucket").where("a <> b"), "neardup-held")
        if held.isEmpty():
            break
        pairs = held.groupBy("a", "b").agg(F.count("*").alias("buckets"))
        sims = None
        if turn == 0:  # one hub a member, the one met most often, settles most of them
            sims = check(pairs.groupBy("b").agg(F.max_by("a", F.struct("buckets", "a")).alias("a")).select("a", "b"))
            pairs = pairs.join(sims.select("a", "b"), ["a", "b"], "left_anti")
        rest = store(labelled(pairs.select("a", "b"), labels), "neardup-rest")
        if not rest.isEmpty():
            more = check(rest)
            sims = more if sims is None else sims.unionByName(more)
        if sims is None:  # every member is linked to its hub already
            break
        # pairs inside a component need no link, so only buckets with a member outside the hub's component go on
        unlike = store(labelled(sims.where(F.col("sim") < least).select("a", "b"), labels).withColumn("apart", F.lit(True)), "neardup-unlike")
        if unlike.isEmpty():
            break
        split = store(held.join(unlike, ["a", "b"], "left").select("bucket", F.col("b").alias("node"), F.col("apart").isNotNull().alias("outer")), "neardup-split")
        mixed = split.groupBy("bucket").agg(F.count_if("outer").alias("n_outer"), F.count_if(~F.col("outer")).alias("n_inner")).where("n_outer > 0")
        known = store(split.join(small_or_shuffled(store(mixed, "neardup-mixed")), "bucket"), "neardup-known")
        sides.append(known.where("n_inner > 0").select(F.lit(turn).alias("turn"), "bucket", "node", (~F.col("outer")).alias("inner"), "outer", "n_inner", "n_outer"))
        alive = known.where("outer and n_outer > 1").select("bucket", "node", "n_outer")
    else:  # each of these against each
        yes, n = F.lit(True), F.col("n_outer")
        sides.append(alive.select(F.lit(rounds).alias("turn"), "bucket", "node", yes.alias("inner"), yes.alias("outer"), n.alias("n_inner"), n.alias("n_outer")))
    if sides:
        met = reduce(DataFrame.unionByName, sides)
        open_ones = small_or_shuffled(store(met.select("node").distinct(), "neardup-open"))
        marks = store(marked(texts.join(open_ones, "node", "left_semi"), words, places), "neardup-marks")
        mean, enough = places * least, least_agreement(places, least)
        for low, top in ((mean, places + 1), (enough, mean)):  # the most alike first: their links join most of what the others ask
            likely = alike_in_blocks(met, labels, marks, places, low, top).select("a", "b")
            if not likely.isEmpty():
                check(likely)

    nodes = docs.select("node").distinct()
    if labels is None:
        return docs.select("doc_id", "node"), nodes.withColumn("class", F.col("node"))
    classes = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("class"))
    return docs.select("doc_id", "node"), classes


def class_ids(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size), a row per row: the smallest id of the class, and its number of rows."""
    per_node = docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(classes, "node")
    per_class = per_node.groupBy("class").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    named = store(per_node.select("node", "class").join(per_class, "class").select("node", "class_id", "class_size"), "neardup-classes")
    return docs.join(named, "node").select("doc_id", "class_id", "class_size")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with one row of each class: the smallest id (null last), of equal rows one."""
    docs, classes = near_duplicates(df, id_col, text_col, **how)
    keys = docs.groupBy("doc_id", "node").agg(F.count("*").alias("n")).join(classes, "node")
    first = keys.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("keep"))
    d, node, key = free_names(df, "d", "node", "key")
    marked = store(
        keys.join(first, "class").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("node") == F.col("keep.node")))
        .select(F.col("doc_id").alias(d), F.col("node").alias(node), F.col("stays"), F.col("n")),
        "neardup-marked",
    )
    names = columns_of(df)
    keyed = df.withColumn(key, node_of(text_or_empty(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(node))
    kept = keyed.join(small_or_shuffled(marked.where("not stays").select(d, node)), same, "left_anti")
    repeated = marked.where("stays and n > 1").select(d, node)
    if repeated.isEmpty():
        return kept.select(*names)
    repeated = small_or_shuffled(repeated)
    single = kept.join(repeated, same, "left_anti")
    return single.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, key])).select(*names)
