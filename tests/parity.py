"""Compare a registered query with its DuckDB oracle: names, types, row count, values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, sf_dir: str, name: str, queries, oracles) -> str:
    """An empty string when equal, otherwise what differs."""
    df = queries[name](spark, sf_dir)
    rows = df.collect()
    if name not in oracles:
        return "" if rows else "no rows"
    con = duck(sf_dir)
    cursor = con.execute(oracles[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    problems = []
    for field in df.schema.fields:
        want = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if want != kinds[field.name].split("(")[0]:
            problems.append(f"type {field.name}: {field.dataType.simpleString()} vs {kinds[field.name]}")
    order = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    mine = Counter(tuple(canonical(r[n]) for n in order) for r in rows)
    theirs = Counter(tuple(canonical(r[at[n]]) for n in order) for r in expected)
    if mine != theirs:
        only_mine = list((mine - theirs).elements())[:3]
        only_theirs = list((theirs - mine).elements())[:3]
        problems.append(
            f"rows {len(rows)} vs {len(expected)}; {order}\n   ours   {only_mine}\n   oracle {only_theirs}"
        )
    elif not rows:
        problems.append("no rows")
    return "; ".join(problems)


def main(patterns: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from vecmeadow.session import get_spark

    spark = get_spark(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        started = time.time()
        try:
            problem = compare(spark, sf_dir, name, queries, oracles)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "oracle" if name in oracles else "rows"
        print(f"{'ok ' if not problem else 'BAD'} {name} [{kind}] {time.time() - started:.1f}s {problem}", flush=True)
        bad += bool(problem)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:]
    where = "/root/testdata/sf0.01"
    if arguments and arguments[0].startswith("/"):
        where = arguments.pop(0)
    sys.exit(1 if main(arguments, where) else 0)
