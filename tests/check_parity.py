"""Compare registered queries with their SQL: python tests/check_parity.py [folder] [name part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def family(kind: str) -> str:
    """Broad type family, the same for both engines' type names."""
    k = kind.lower()
    if k.startswith(("bigint", "int", "smallint", "long", "hugeint", "tinyint", "uint", "ubigint")):
        return "int"
    if k.startswith(("double", "float")):
        return "float"
    if k.startswith("decimal"):
        return "decimal"
    if k.startswith(("string", "varchar")):
        return "text"
    if k.startswith("timestamp"):
        return "timestamp"
    return k


def compare(spark_df, con, sql):
    """Empty text when both sides agree, else what differs."""
    got_names, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    want_names, want_types = [d[0] for d in res.description], [str(d[1]) for d in res.description]
    want = res.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    kinds = dict(zip(want_names, want_types))
    odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in spark_df.schema
           if family(f.dataType.simpleString()) != family(kinds[f.name])]
    if odd:
        return f"types {odd}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        diff = [(n, p, q) for n, p, q in zip(sorted(got_names), *bad[0]) if p != q]
        return f"{len(bad)} rows differ, first: {diff}"
    return ""


def main():
    from salesloom.session import build
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    if os.environ.get("CHECK_ZONE"):  # a session without this library's settings, in another time zone
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", os.environ["CHECK_ZONE"]).config(
            "spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = build("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed, only_rows = [], 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(run(spark, folder), con, oracles[name])
            else:
                only_rows += 1
                problem = "" if run(spark, folder).count() > 0 else "no rows"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {time.time() - start:6.2f}s {name} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed {failed}; {only_rows} without SQL; "
          f"SQL without query {sorted(set(oracles) - set(queries))}")


if __name__ == "__main__":
    main()
