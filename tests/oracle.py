"""Runs registered queries against their DuckDB SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v)

    return sorted(tuple(map(cell, r)) for r in rows)


def compare(spark, name, sf_dir):
    """None if the results are equal, else what differs."""
    import duckdb

    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = normal(df.select(*[f"`{n}`" for n in names]).collect())
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    want = normal([tuple(r[k] for k in order) for r in rel.fetchall()])
    if got != want:
        return f"{len(got)} rows and {len(want)}; first difference {next(((a, b) for a, b in zip(got, want) if a != b), (got[:1], want[:1]))}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as e

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    bad = 0
    for name in sys.argv[2:] or [n for n in e.queries() if not n.startswith(("op", "pipeline")) or n == "order_limit_offset"]:
        began = time.time()
        try:
            told = compare(spark, name, where)
        except Exception as error:  # noqa: BLE001
            told = f"{type(error).__name__}: {str(error)[:400]}"
        bad += told is not None
        print(f"{'ok  ' if told is None else 'FAIL'} {name} {time.time() - began:.1f}s {told or ''}", flush=True)
    sys.exit(bad)
