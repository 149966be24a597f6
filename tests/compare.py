"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def differences(spark, con, build, sql, sf_dir) -> str:
    """'' when both sides agree, else a short account."""
    df = build(spark, sf_dir)
    mine, mine_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs, their_names = _rows(names, result.fetchall())
    if mine_names != their_names:
        return f"columns {mine_names} vs {their_names}"
    if mine != theirs:
        a = [r for r in mine if r not in theirs][:3] if len(mine) < 5000 else []
        b = [r for r in theirs if r not in mine][:3] if len(mine) < 5000 else []
        return f"{len(mine)} vs {len(theirs)} rows; only here {a}; only there {b}"
    return "" if mine else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in names:
        t = time.time()
        sql = entry.oracle_sql().get(n)
        try:
            if sql is None:
                print(f"{n:28s} rows {entry.queries()[n](spark, sf).count()} (no SQL)", flush=True)
                continue
            d = differences(spark, con, entry.queries()[n], sql, sf)
        except Exception as exc:
            d = "ERROR " + str(exc)[:600]
        print(f"{n:28s} {time.time() - t:6.2f}s {'ok' if not d else d}"[:1500], flush=True)
