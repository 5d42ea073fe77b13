"""Runs queries beside their SQL: python tests/oracle.py DIR [NAME...] prints what differs."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "ddr_run", "files", "entities", "core_entities", "refs", "page_labels", "eval_items", "mix_targets"]


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(base, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, base: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, base)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    more, less = got - want, want - got
    if more or less:
        return f"{sum(got.values())} rows against {sum(want.values())}; only ours {list(more)[:3]}; only SQL {list(less)[:3]}"
    return "" if got else "EMPTY"


def main(base: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from tests.conftest import make_spark

    spark, con, bad = make_spark(), connect(base), 0
    qs, sql = e.queries(), e.oracle_sql()
    for n in names or qs:
        t = time.time()
        try:
            said = compare(spark, con, qs[n], sql[n], base) if n in sql else f"no SQL, {qs[n](spark, base).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{n} {time.time() - t:.1f} s {said or 'ok'}", flush=True)
    print(f"{bad} of {len(names or qs)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
