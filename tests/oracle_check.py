"""Run registered queries against their DuckDB oracle: python tests/oracle_check.py [key ...]."""

from __future__ import annotations

import os
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v if isinstance(v, (int, str)) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in pdf.itertuples(index=False)), key=repr)


def compare(spark_df, sql: str, con) -> str:
    """Empty string on a match, else a short description of the difference."""
    mine = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    a, b = _norm(mine), _norm(theirs)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}\n   spark only: {only_a}\n   oracle only: {only_b}"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf_dir), queries(), oracle_sql()
    wanted = sys.argv[1:] or list(q)
    bad = 0
    for key in wanted:
        start = time.time()
        try:
            if key in o:
                msg = compare(q[key](spark, sf_dir), o[key], con)
                note = f"rows={len(con.execute(o[key]).df())}"
            else:
                rows = q[key](spark, sf_dir).toPandas()
                msg, note = "", f"rows-only={len(rows)}"
        except Exception as e:  # report and go on
            msg, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {key:26s} {time.time() - start:6.2f}s {note} {msg}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
