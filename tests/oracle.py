"""Order-insensitive comparison of a Spark result with a DuckDB query."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c.lower() for c in columns), Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    table = df.toArrow()
    cols = table.column_names
    data = list(zip(*[table.column(i).to_pylist() for i in range(len(cols))])) if cols else []
    return _rows(cols, data), {n: str(t) for n, t in zip(cols, table.schema.types)}


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    return _rows(cols, cur.fetchall()), types


def difference(df, con, sql):
    """None when equal, else a short description."""
    (ca, ra), ta = spark_rows(df)
    (cb, rb), tb = duck_rows(con, sql)
    if ca != cb:
        return f"columns differ: spark {ca} duckdb {cb}"
    if ra != rb:
        only_a, only_b = ra - rb, rb - ra
        return (f"rows: spark {sum(ra.values())} duckdb {sum(rb.values())}; only spark {sum(only_a.values())} "
                f"{list(only_a)[:2]}; only duckdb {sum(only_b.values())} {list(only_b)[:2]}; columns {ca}")
    wide = [c for c, t in tb.items() if "HUGEINT" in t.upper() or "DECIMAL" in t.upper()]
    if wide:
        return f"oracle type not portable: {[(c, tb[c]) for c in wide]}"
    return None
