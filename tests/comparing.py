"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value + 0.0:.10g}") or 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    got_rows = df.collect()
    got = rows_of(df.columns, got_rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(names, cur.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    spark_kinds = dict(df.dtypes)
    same = {
        "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
        "date": {"DATE"}, "timestamp_ntz": {"TIMESTAMP"}, "boolean": {"BOOLEAN"},
    }
    for n in names:
        kind = spark_kinds.get(n)
        if kind in same and kinds[n] not in same[kind]:
            problems.append(f"type of {n}: {kind} vs {kinds[n]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    seen_got, seen_want = set(got), set(want)
    only_got = [r for r in got if r not in seen_want]
    only_want = [r for r in want if r not in seen_got]
    if only_got or only_want:
        problems.append(f"only in Spark ({len(only_got)}): {only_got[:3]}; only in SQL ({len(only_want)}): {only_want[:3]}")
    return problems
