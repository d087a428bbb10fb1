"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if type(value).__name__ == "Timestamp":
        return value.to_pydatetime()
    return value


def sort_key(row):
    return tuple((str(type(v).__name__) if v is not None else "", repr(v)) for v in row)


def loose(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, tuple):
        return tuple(loose(v) for v in value)
    return value


def compare(spark, entry, sf_dir: str, con=None) -> tuple[str, str]:
    """('ok' | 'approx' | 'rows' | 'FAIL', message)."""
    frame = entry(spark, sf_dir)
    names = sorted(frame.columns)
    got = [tuple(plain(r[n]) for n in names) for r in frame.select(*names).collect()]
    if entry.sql is None:
        return "rows", f"{len(got)} rows, {names}"
    con = con or connect(sf_dir)
    cur = con.execute(entry.sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return "FAIL", f"columns {names} != {sorted(cols)}"
    index = [cols.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in index) for r in cur.fetchall()]
    if len(got) != len(want):
        return "FAIL", f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    if got == want:
        kinds = {}
        for rows, label in ((got, "spark"), (want, "sql")):
            for n, i in zip(names, range(len(names))):
                kinds.setdefault(n, {}).setdefault(label, set()).update(
                    type(r[i]).__name__ for r in rows[:500] if r[i] is not None
                )
        odd = {n: k for n, k in kinds.items() if k.get("spark") != k.get("sql")}
        if odd:
            return "approx", f"{len(got)} rows, python types differ {odd}"
        return "ok", f"{len(got)} rows"
    if sorted(map(loose, got), key=sort_key) == sorted(map(loose, want), key=sort_key):
        return "approx", f"{len(got)} rows equal only after rounding"
    gs, ws = set(got), set(want)
    return "FAIL", (
        f"{len(got)} rows {names}\n   only spark: {sorted(gs - ws, key=sort_key)[:3]}"
        f"\n   only sql:   {sorted(ws - gs, key=sort_key)[:3]} ({len(gs - ws)})"
    )


if __name__ == "__main__":
    import __spark_entry__ as entrypoint
    from swathline.plans.registry import ENTRIES
    from swathline.session import build_session

    sf = sys.argv[1]
    entrypoint.queries()
    picks = [n for n in ENTRIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = build_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in picks:
        start = time.time()
        try:
            status, message = compare(spark, ENTRIES[name], sf_dir, con)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, message = "ERROR", str(error)[:1200]
            if os.environ.get("TB"):
                traceback.print_exc()
        bad += status in ("FAIL", "ERROR", "approx")
        print(f"{status:6} {name:34} {time.time() - start:6.2f}s  {message}", flush=True)
    print("checked", len(picks), "bad", bad)
