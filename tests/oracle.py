"""Runs registered queries against their SQL twins; `python tests/oracle.py [sf] [name ...]`."""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session():
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    return "none" if value is None else type(value).__name__


def compare(df, con, sql: str) -> tuple[int, str | None]:
    """(rows, problem or None)."""
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return len(ours), f"columns {columns} != {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return len(ours), f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or any(kind(x) != kind(y) for x, y in zip(a, b)):
            return len(ours), f"{columns}: {str(a)[:400]} != {str(b)[:400]}"
    return len(ours), None


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                rows, problem = compare(df, con, oracles[name])
            else:
                rows, problem = len(df.collect()), None
        except Exception as e:
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5}{name:32}{rows:9}{time.time() - start:8.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
