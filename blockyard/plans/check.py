"""Side-by-side check of a registered query against its DuckDB oracle
(row count, column names, order-insensitive values; doubles rounded)."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
import pandas as pd

from blockyard.session import TABLES


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "None"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        r = round(v, 6)
        return f"{r + 0.0:.6f}"
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return "[" + ",".join(_norm(x) for x in list(v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir: str, names=None, verbose=True) -> dict:
    from blockyard.plans.catalog import REGISTRY
    con = duck(sf_dir)
    res = {}
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, res[name], flush=True)
            continue
        t1 = time.time()
        if sql is None:
            res[name] = f"rows-only {len(sdf)}"
        else:
            try:
                odf = con.sql(sql).df()
            except Exception as e:  # noqa: BLE001
                res[name] = f"DUCK ERROR {str(e)[:300]}"
                if verbose:
                    print(name, res[name], flush=True)
                continue
            if sorted(sdf.columns) != sorted(odf.columns):
                res[name] = f"COLUMNS {sorted(sdf.columns)} vs {sorted(odf.columns)}"
            elif len(sdf) != len(odf):
                res[name] = f"ROWCOUNT {len(sdf)} vs {len(odf)}"
            else:
                a, b = _rows(sdf), _rows(odf)
                if a == b:
                    res[name] = f"ok {len(sdf)}"
                else:
                    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                    res[name] = f"VALUES {sorted(sdf.columns)} {diff}"
        if verbose:
            print(f"{name}: {res[name]} ({t1 - t0:.1f}s)", flush=True)
    return res


if __name__ == "__main__":
    from blockyard.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    r = check(spark, sf, names)
    bad = {k: v for k, v in r.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(f"\n{len(r) - len(bad)}/{len(r)} ok; bad: {sorted(bad)}")
