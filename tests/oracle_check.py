"""Compare registered queries with their SQL twins in DuckDB: columns, row count, values."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
    return df


def _kind(dtype) -> str:
    text = str(dtype)
    return "datetime" if text.startswith("datetime64") else text


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    a, b = _plain(spark_df), _plain(sql_df)
    if list(a.columns) != list(b.columns):
        return [f"columns {list(a.columns)} != {list(b.columns)}"]
    out = []
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    kinds = {c: (_kind(a[c].dtype), _kind(b[c].dtype)) for c in a.columns}
    out += [f"type of {c}: {x} != {y}" for c, (x, y) in kinds.items() if x != y]

    def rows(df):
        return sorted(tuple(map(str, r)) for r in df.itertuples(index=False, name=None))

    ra, rb = rows(a), rows(b)
    if ra != rb:
        sa, sb = set(ra), set(rb)
        only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        out.append(f"values differ ({len(sa - sb)} / {len(sb - sa)}) over {list(a.columns)}")
        out += [f"  spark {r}" for r in only_a] + [f"  sql   {r}" for r in only_b]
    return out


def main(pattern: str = "", sf: str = "0.01") -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from runledger.session import local_session

    sf_dir = sf if "/" in sf else f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if pattern and not any(p in name for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            t1 = time.time()
            want = con.execute(oracles[name]).df()
            problems = compare(got, want)
            sqls = time.time() - t1
        except Exception as e:  # noqa: BLE001
            problems, took, got, sqls = [f"{type(e).__name__}: {str(e)[:1200]}"], time.time() - start, [], 0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok   '} {name} {len(got)} rows {took:.1f}s sql {sqls:.1f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
