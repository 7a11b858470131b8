"""Compare a registered query with its SQL twin on the same parquet files."""
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if isinstance(v, str) else str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """(spark rows, sql rows, list of problems)."""
    cur = con.execute(sql)
    sql_cols = [c[0] for c in cur.description]
    expected = bag(sql_cols, cur.fetchall())
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(df.columns) != sorted(sql_cols):
        problems.append(f"columns {sorted(df.columns)} != {sorted(sql_cols)}")
    missing, extra = expected - got, got - expected
    if missing or extra:
        problems.append(f"{sum(missing.values())} missing e.g. {list(missing)[:1]}; "
                        f"{sum(extra.values())} extra e.g. {list(extra)[:1]}")
    return sum(got.values()), sum(expected.values()), problems
