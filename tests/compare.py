"""Run registered queries next to DuckDB and compare the rows exactly."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _text(x) -> str:
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return "~"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(x + 0.0)
    return str(x)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [frame[n].astype(object).tolist() for n in names]
    return sorted(tuple(_text(v) for v in row) for row in zip(*columns))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {n: str(frame[n].dtype) for n in sorted(frame.columns)}


def differences(spark, con, name: str, sf_dir: str) -> str | None:
    """None where both sides agree, else a short account of the difference."""
    ours = queries()[name](spark, sf_dir).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        return None
    theirs = con.execute(sql).fetch_df() if hasattr(con, "fetch_df") else con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: {[r for r in a if r not in set(b)][:2]} / {[r for r in b if r not in set(a)][:2]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows: {bad[0]}"
    if kinds(ours) != kinds(theirs):
        off = {n: (k, kinds(theirs)[n]) for n, k in kinds(ours).items() if kinds(theirs)[n] != k}
        print("   types differ", name, off)
    return None


if __name__ == "__main__":
    from spanwise.session import local_session

    spark = local_session(8)
    sf_dir = sys.argv[1]
    want = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    con = connect(sf_dir)
    bad = 0
    for name in queries():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            diff = differences(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        mark = "OK  " if diff is None else "BAD "
        print(mark, name, "" if name in oracle_sql() else "(rows only)", f"{time.time() - t:.1f}s", diff or "", flush=True)
    print("bad:", bad)
