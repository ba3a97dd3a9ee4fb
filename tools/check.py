"""Compare registered queries with their SQL on DuckDB: row count, schema, order-free values."""

from __future__ import annotations

import importlib.util
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    if v is pd.NaT:
        return None
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main(argv):
    sf = os.environ.get("CHECK_SF", "0.001")
    sf_dir = f"/root/testdata/sf{sf}"
    from veridoc.session import build_session
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC"})
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = []
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.collect()
            dt = time.time() - t
            cols = df.columns
            if name not in sqls:
                print(f"ROWS  {name:38s} {len(got):8d} rows {dt:6.1f}s", flush=True)
                continue
            t = time.time()
            con = duckdb.connect()
            for tb in TABLES:
                con.execute(f"create view {tb} as select * from '{sf_dir}/{tb}.parquet'")
            rel = con.execute(sqls[name])
            ocols = [d[0] for d in rel.description]
            otypes = {d[0]: str(d[1]) for d in rel.description}
            want = rel.fetchall()
            ot = time.time() - t
            a, b = rows(cols, got), rows(ocols, want)
            ok = sorted(cols) == sorted(ocols) and a == b
            st = {f.name: f.dataType.simpleString() for f in df.schema}
            print(f"{'OK   ' if ok else 'FAIL '} {name:38s} {len(got):8d} rows {dt:6.1f}s  sql {ot:5.1f}s", flush=True)
            odd = {c: (st[c], otypes.get(c)) for c in st if not same_type(st[c], otypes.get(c, ""))}
            if odd:
                print("   types", odd)
            if not ok:
                bad.append(name)
                print("   cols", sorted(cols), sorted(ocols), len(want))
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for label, only in (("spark", sa - sb), ("sql", sb - sa)):
                    for r in sorted(only)[:3]:
                        print("   only", label, r[:600])
            if ok and not got:
                print("   EMPTY")
        except Exception:
            bad.append(name)
            print("ERROR", name)
            print("\n".join(x[:260] for x in traceback.format_exc().splitlines()[-40:] if "pyspark.errors" in x or "File \"/root" in x or "Error" in x)[:1800], flush=True)
    print("checked", len(names), "bad", bad)


def same_type(s, d):
    pairs = {"string": ("VARCHAR", "STRING"), "bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "boolean": ("BOOLEAN",),
             "array<string>": ("VARCHAR[]",), "array<int>": ("INTEGER[]",), "timestamp": ("TIMESTAMP",)}
    return d in pairs.get(s, (d,))


main(sys.argv[1:])
