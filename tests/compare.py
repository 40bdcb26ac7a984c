"""Run registered queries on Spark and their SQL on DuckDB and compare the row multisets."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    return str(value)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, query):
    """(ok, message) for one registered query."""
    df = query.build(spark, folder)
    names = sorted(df.columns)
    rows = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if query.sql is None:
        return True, f"rows only: {sum(rows.values())}"
    found = con.sql(query.sql)
    if sorted(found.columns) != names:
        return False, f"columns {names} != {sorted(found.columns)}"
    order = [found.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    types = {n: str(t) for n, t in zip(found.columns, found.types)}
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if rows == want:
        return True, f"{sum(rows.values())} rows | " + ", ".join(
            f"{n}:{mine[n]}/{types[n]}" for n in names
            if EQUAL.get(mine[n]) != types[n]
        )
    extra = list((rows - want).items())[:3]
    missing = list((want - rows).items())[:3]
    return False, (
        f"{sum(rows.values())} vs {sum(want.values())} rows\n   cols  {names}\n"
        f"   spark {extra}\n   duck  {missing}"
    )


EQUAL = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
}


def main(argv):
    import __spark_entry__  # noqa: F401
    from gridwright.catalog import REGISTRY
    from gridwright.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name, query in REGISTRY.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, query)
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
