"""Compare registered queries with DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
import traceback
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

DUCK_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows under the same column names."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    theirs = {d[0]: str(d[1]) for d in result.description}
    types = {c: (t, theirs[c]) for c, t in df.dtypes if DUCK_TYPES.get(t) != theirs[c]}
    if types:
        return f"types {types}"
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(value(row[i]) for i in order) for row in result.fetchall())
    ours = Counter(tuple(value(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return (
        f"rows {sum(ours.values())} vs {sum(theirs.values())}; columns {columns};"
        f" only ours {list(extra.items())[:2]}; only theirs {list(missing.items())[:2]}"
    )


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            problem = difference(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
