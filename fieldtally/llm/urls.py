"""URL filter: one trie over reversed host labels, then path segments, sent to every task.

A rule names a host and the beginning of a path; it fits that host and all hosts below it.  The walk goes
down the labels from the right, and at every node reached down the rule paths kept there.  Of all rules that
fit, the longest wins: more host labels first, then the longer path.

The verdict of a url no rule fits is ``default``, unless the filter's own entries (``extra``) decide; they are
walked in a trie of their own and never show up as ``rule``.  A null url, or one without ``://``, has an empty
host and path; only the default applies to it.  Repeated urls get equal verdicts, an empty table none; a url of any length is
walked as far as the trie goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import ship

Rule = tuple[str, str, str]  # verdict, host, path

RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Kinds of sites that the filter blocks by itself where no rule speaks, below these domains.
EXTRA: tuple[Rule, ...] = tuple(
    ("block", f"{label}.{domain}", "/")
    for domain in ("example.com", "example.org")
    for label in ("adult-x", "casino-win", "ads-track")
)
#: More entries than this are no list to broadcast; split them by host and join instead.
MOST_RULES = 1_000_000

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_PARTS = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


@dataclass
class Node:
    below: dict[str, Node] = field(default_factory=dict)
    verdict: str | None = None
    name: str | None = None
    paths: Node | None = None
    longest: int = 0  # characters of the longest piece below


def trie(rules: Iterable[Rule]) -> Node:
    """Host labels from the right, then path pieces (each with its slash); one rule twice: block wins."""
    top = Node()
    for count, (verdict, host, path) in enumerate(rules):
        if count >= MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        node = top
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        for piece in pieces(path):
            node.longest = max(node.longest, len(piece))
            node = node.below.setdefault(piece, Node())
        if node.verdict != "block":
            node.verdict, node.name = verdict, f"{host}{path}"
    return top


def pieces(path: str) -> list[str]:
    """``/a/b/c`` as ``/``, ``a/``, ``b/``, ``c``."""
    return re.findall(r"[^/]*/|[^/]+", path)


def longest_path(top: Node, path: str) -> Node | None:
    """The deepest node whose rule is a prefix of the path; the last piece of a rule may end inside a segment."""
    best = top if top.verdict else None
    node, rest = top, path
    while True:
        cut = rest.find("/") + 1
        segment = rest[:cut] if cut else rest
        if not segment:
            return best
        for length in range(min(len(segment) - 1, node.longest), 0, -1):  # rules that end within this segment
            inner = node.below.get(segment[:length])
            if inner is not None and inner.verdict:
                best = inner
                break
        node = node.below.get(segment)
        if node is None:
            return best
        if node.verdict:
            best = node
        rest = rest[len(segment) :]


def lookup(top: Node, host: str, path: str) -> Node | None:
    best, node = None, top
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            return best
        if node.paths is not None:
            best = longest_path(node.paths, path) or best
    return best


def split_url(url: str | None) -> tuple[str, str]:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _PARTS.match(rest)[0]
    tail = rest[len(host) :]
    return host.translate(_UPPER), _PATH.match(tail)[0]


FIELDS = StructType([StructField(n, StringType()) for n in ("host", "path", "rule", "verdict")])


def filter_urls(
    df: DataFrame, url: str = "url", out: str = "filtered", rules: Iterable[Rule] = RULES, extra: Iterable[Rule] = EXTRA, default: str = "allow"
) -> DataFrame:
    """Adds (or replaces) the struct ``out`` (host, path, rule, verdict); other columns stay."""
    spark = df.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast((tuple(rules), tuple(extra)))
    tries: list[Node] = []

    @F.arrow_udf(FIELDS)
    def judged(urls: pa.Array) -> pa.Array:
        if not tries:
            tries.extend(map(trie, given.value))
        rows = []
        for u in urls.to_pylist():
            host, path = split_url(u)
            found = lookup(tries[0], host, path) if host else None
            other = lookup(tries[1], host, path) if host and not found else None
            rows.append((host, path, found.name if found else None, (found or other).verdict if found or other else default))
        columns = zip(*rows) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=FIELDS.names)

    return df.withColumn(out, judged(F.col(url)))
