"""Run registered queries next to their SQL counterparts: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(path: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, path: str, query, sql: str) -> str:
    """Empty when both give the same rows, else what differs."""
    df = query(spark, path)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first: {str(bad[0])[:700]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from flockline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path = f"/root/testdata/sf{sf}"
    spark = local_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, queries = duck(path), entry.oracle_sql(), entry.queries()
    names = sys.argv[2:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, path, queries[name], oracles[name])
            else:
                n = queries[name](spark, path).count()
                problem = "" if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(len(names) - len(failed), "of", len(names), "ok; failed:", failed)


if __name__ == "__main__":
    main()
