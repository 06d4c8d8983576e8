"""Compare a query's rows with its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int):
        return x
    return float(x) if type(x).__name__ == "Decimal" else x


def ordered(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in r))


def difference(con, spark_df, sql: str) -> str | None:
    """None if both agree."""
    names = sorted(spark_df.columns)
    ours = ordered(tuple(r[n] for n in names) for r in spark_df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    theirs = ordered(con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql.rstrip().rstrip(';')})").fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}: {ours[:2]} {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ: {bad[:3]}" if bad else None if ours else "no rows"
