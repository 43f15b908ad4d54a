"""Compare each registered query with its DuckDB oracle (row count, column names and an
order-insensitive hash of the values). Used by the tests and as a command:

    python -m rivulet.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (int, str)):
        return v
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return len(keyed), hashlib.sha256("\n".join(keyed).encode()).hexdigest()


def duck(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from rivulet.plans.catalog import QUERIES
    from rivulet.plans.oracle import oracle_sql
    sqls = oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        res = {"spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
        if name in sqls:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
            res.update(duck_rows=len(d_rows), cols_match=sorted(s_cols) == sorted(d_cols))
            res["hash_match"] = (res["cols_match"]
                                 and digest(s_cols, s_rows) == digest(d_cols, d_rows))
            if not res["cols_match"]:
                res["spark_cols"], res["duck_cols"] = sorted(s_cols), sorted(d_cols)
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


def main(argv):
    from rivulet.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf_dir, argv[2:] or None)
    bad = [k for k, v in res.items() if not v.get("hash_match", True)]
    print("MISMATCH:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
