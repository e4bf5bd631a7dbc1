"""Run a registered query and its SQL twin and compare names, types and values exactly."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) else v) if v is not None else (False, "", 0) for v in row)


DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "HUGEINT": "hugeint", "FLOAT": "float",
}


def compare(spark, con, name, fn, sql, sf) -> list[str]:
    """Differences as readable lines; empty when everything matches."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [tuple(_norm(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    rel = con.sql(sql)
    duck_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    problems = []
    if sorted(duck_types) != names:
        return [f"columns {names} vs {sorted(duck_types)}"]
    if duck_types != spark_types:
        problems.append(f"types { {c: (spark_types[c], duck_types[c]) for c in names if spark_types[c] != duck_types[c]} }")
    order = [rel.columns.index(c) for c in names]
    expected = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    if not rows:
        problems.append("no rows")
    if len(rows) != len(expected):
        problems.append(f"rows {len(rows)} vs {len(expected)}")
    rows.sort(key=_key)
    expected.sort(key=_key)
    bad = [(a, b) for a, b in zip(rows, expected) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {names}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}")
    return problems


def main(argv):
    from fieldtally.catalog import ORACLES, QUERIES
    from tests.conftest import make_session

    sf = "/root/testdata/" + (argv[0] if argv else "sf0.01")
    only = argv[1:]
    spark, con = make_session(), oracle(sf)
    failed = 0
    for name, fn in QUERIES.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                problems = compare(spark, con, name, fn, ORACLES[name], sf)
            else:
                n = fn(spark, sf).count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:26s} {time.time() - t:6.2f}s {'' if name in ORACLES else '(rows only)'}", *problems, sep="\n   " if problems else " ", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
