"""Run registered queries and their SQL side by side:  python tests/compare.py [-s SF] [names...]"""

from __future__ import annotations

import logging
import os
import sys
import time
import traceback
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        col = frame[name]
        if col.dtype.kind == "M":
            frame[name] = col.astype("datetime64[us]").astype(str)
        elif col.dtype == object or str(col.dtype) in ("string", "str"):
            frame[name] = [None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v) for v in col]
        else:
            frame[name] = [None if v is None or (isinstance(v, float) and np.isnan(v)) else v for v in col.astype(object)]
    return Counter(map(repr, map(tuple, frame.to_numpy(dtype=object).tolist())))


def arrow_types(schema) -> dict[str, str]:
    def simple(t: str) -> str:
        return (
            t.replace("large_string", "string")
            .replace("string_view", "string")
            .replace("timestamp[us, tz=UTC]", "timestamp[us]")
        )

    return {f.name: simple(str(f.type)) for f in schema}


def compare(spark, name, fn, sql, sf_dir, show=3):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    start = time.time()
    got = fn(spark, sf_dir).toArrow()
    took = time.time() - start
    if sql is None:
        return "rows-only", took, 0.0, f"{got.num_rows} rows"
    start = time.time()
    want = con.execute(sql).to_arrow_table()
    sql_took = time.time() - start
    gt, wt = arrow_types(got.schema), arrow_types(want.schema)
    notes = []
    if gt != wt:
        notes.append(f"types {({k: (gt.get(k), wt.get(k)) for k in gt.keys() | wt.keys() if gt.get(k) != wt.get(k)})}")
    if got.num_rows != want.num_rows:
        notes.append(f"rows {got.num_rows} vs {want.num_rows}")
    if set(gt) == set(wt):
        a, b = normal(got.to_pandas()), normal(want.to_pandas())
        if a != b:
            sa, sb = set(a - b), set(b - a)
            notes.append(f"values differ: only spark {[x[:600] for x in sorted(sa - sb)[:show]]} only sql {[x[:600] for x in sorted(sb - sa)[:show]]}")
    return ("OK" if not notes else "DIFF"), took, sql_took, "; ".join(notes) or f"{got.num_rows} rows"


def main() -> int:
    logging.disable(logging.CRITICAL)
    import __spark_entry__ as entry
    from lingualoom.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    bad = 0
    for name in names:
        try:
            status, took, sql_took, note = compare(
                spark, name, queries[name], oracle.get(name), f"/root/testdata/sf{sf}"
            )
        except Exception as exc:  # noqa: BLE001
            status, took, sql_took, note = "FAIL", 0, 0, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status in ("DIFF", "FAIL")
        print(f"{status:9} {name:28} spark {took:6.2f}s sql {sql_took:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
