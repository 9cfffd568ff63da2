"""Compare queries with their SQL, as the driver does."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings binaries program_functions instructions clone_pairs clone_families candidate_pairs motifs_k10 frequency_table opcode_ref eval_items mix_targets page_labels".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else ("f", float(f"{x:.9g}"))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def difference(spark, con, query, sql: str, folder: str) -> str:
    """Empty if both have the same columns and rows."""
    df = query(spark, folder)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    if got == want:
        return ""
    extra, missing = list(set(got) - set(want))[:3], list(set(want) - set(got))[:3]
    return f"{len(got)} rows against {len(want)}; columns {order}; only Spark {extra}; only SQL {missing}"
