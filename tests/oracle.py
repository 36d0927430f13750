"""Run registered queries against their SQL twins; `python -m tests.oracle DIR [NAME...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v
    return [sorted(columns)], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    out = query(spark, sf_dir)
    got = rows(out.columns, out.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return f"{len(got[1])} rows against {len(want[1])}; {len(extra)} extra such as {sorted(extra, key=repr)[:2]}, {len(missing)} missing such as {sorted(missing, key=repr)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    os.environ["PYTHONPATH"] = os.getcwd()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    names = sys.argv[2:] or [k for k in entry.queries() if not k.startswith(("op", "pipeline"))]
    for k in names:
        began = time.time()
        try:
            sql = entry.oracle_sql().get(k)
            said = compare(session, k, entry.queries()[k], sql, sys.argv[1]) if sql else f"rows {entry.queries()[k](session, sys.argv[1]).count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{k} {time.time() - began:.1f}s {said or 'equal'}", flush=True)
