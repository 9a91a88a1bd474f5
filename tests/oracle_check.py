"""Run registered queries next to their check SQL in DuckDB: python tests/oracle_check.py [substring ...]"""

from __future__ import annotations

import logging
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~null"
        if isinstance(v, bool):
            return repr(v)
        if hasattr(v, "item") and not isinstance(v, (str, bytes)):
            v = v.item() if getattr(v, "ndim", 0) == 0 else v.tolist()
        if isinstance(v, bool):
            return repr(v)
        if isinstance(v, (int, float)):
            return repr(float(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10] if v.isoformat()[10:] in ("", "T00:00:00") else v.isoformat()
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False))


def compare(spark, con, name: str, sf_dir: str) -> str:
    from __spark_entry__ import oracle_sql, queries

    got = queries()[name](spark, sf_dir).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows-only ({len(got)} rows)" if len(got) else "EMPTY"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"ROWS spark {len(a)} duckdb {len(b)}"
    if not a:
        return "EMPTY both sides"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"VALUES {len(bad)}/{len(a)} cols={sorted(got.columns)}\n   spark {only_a[:3]}\n   duck  {only_b[:3]}"
    return f"ok ({len(a)} rows)"


if __name__ == "__main__":
    logging.disable(logging.CRITICAL)
    from rankloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle-check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    from __spark_entry__ import queries

    names = [n for n in queries() if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e)[: int(os.environ.get("ERRLEN", "700"))]
        if not res.startswith(("ok", "rows-only")):
            bad += 1
        print(f"{n}: {res}  [{time.time() - t:.1f}s]", flush=True)
    print(f"{len(names)} queries, {bad} not ok")
