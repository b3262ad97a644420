"""Runs registered queries next to their SQL and compares the rows. Usage: python tests/oracle_tool.py [sf] [name...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def table_rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def compare(spark, con, name, queries, oracles, sf_dir):
    df = queries[name](spark, sf_dir)
    got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got), None
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = table_rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return len(got), f"rows {len(got)} vs {len(want)}; only spark {a}; only sql {b}"
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if t in kinds and kinds[t] != types[c].upper() and not
           (types[c].upper() == "STRING" and t == "string") and not (types[c] == "NUMBER" and t in ("bigint", "double"))]
    return len(got), (f"types {odd}" if odd else "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connect(sf)
    chosen = [q for q in queries if not sys.argv[2:] or any(q.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            n, problem = compare(spark, con, name, queries, oracles, sf)
        except Exception as exc:  # report and go on with the next query
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:700]}"
        state = "rows-only" if problem is None else ("ok" if problem == "" else "FAIL")
        bad += state == "FAIL"
        print(f"{state:9} {name:34} rows={n:6} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {bad} failed")
