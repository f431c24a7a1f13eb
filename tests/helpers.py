"""Compare a registered query with its SQL, as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def differences(df, sql: str, sf_dir: str = DATA) -> list:
    names, want = oracle(sql, sf_dir)
    have = [tuple(r[n] for n in names) for r in df.collect()]
    if sorted(df.columns) != sorted(names) or len(have) != len(want):
        return [("shape", df.columns, names, len(have), len(want))]
    same = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
    return [(a, b) for a, b in zip(ordered(have), ordered(map(tuple, want)), strict=True) if not all(same(x, y) for x, y in zip(a, b, strict=True))]
