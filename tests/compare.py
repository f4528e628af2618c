"""Run queries and their SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz"}


def compare(spark, con, sf_dir, query, sql) -> str:
    """'' if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    kinds = dict(df.dtypes)
    off = [f"{c}: {kinds[c]} != {t}" for c, t in zip(rel.columns, map(str, rel.types))
           if KINDS.get(t, t) != kinds[c]]
    if off:
        return "types " + "; ".join(off)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows on either side"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"[:1500]
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("PARTITIONS", "8"))
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", os.environ.get("ZONE", "UTC"))
             .config("spark.driver.memory", "8g").config("spark.log.level", "ERROR").getOrCreate())
    con, sqls, bad = duck(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sf, query, sqls[name])
            else:
                why = "" if query(spark, sf).count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            why = f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {name:24s} {time.time() - t:6.2f}s {why}", flush=True)
    print("failed:", bad)
