"""Run registered queries against their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """``None`` when equal, else a description of the difference."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows {sum(got.values())} vs {sum(want.values())}; extra {str(extra)[:900]}; missing {str(missing)[:900]}"


def main(argv):
    from veilspan.plans import registry
    from veilspan.session import local_session

    folder = argv[0] if argv and os.path.isdir(argv[0]) else "/root/testdata/sf0.01"
    names = [a for a in argv if not os.path.isdir(a)]
    try:
        registry.load_all()
    except ImportError as e:
        print("partial registry:", e)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    chosen = [q for q in registry.QUERIES if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for q in chosen:
        t = time.time()
        try:
            df = registry.QUERIES[q](spark, folder)
            sql = registry.ORACLES.get(q)
            if sql is None:
                state = f"rows only: {df.count()}"
            else:
                state = compare(df, con, sql) or "ok"
        except Exception as e:  # noqa: BLE001
            state = f"ERROR {type(e).__name__} {str(e)[:700]}"
        bad += not (state == "ok" or state.startswith("rows only"))
        print(f"{time.time() - t:6.1f}s {q}: {state}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
