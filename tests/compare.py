"""Runs a Spark query and its SQL twin and compares names, types and values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb

_SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.12g}") if math.isfinite(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs; empty when the results are equal."""
    names = sorted(spark_df.columns)
    result = con.execute(sql)
    found = {d[0]: str(d[1]) for d in result.description}
    if sorted(found) != names:
        return [f"columns {names} against {sorted(found)}"]
    out = []
    types = dict(spark_df.dtypes)
    for n in names:
        if _SAME.get(types[n]) != found[n]:
            out.append(f"type of {n}: {types[n]} against {found[n]}")
    order = [list(found).index(n) for n in names]
    theirs = _sorted(tuple(row[i] for i in order) for row in result.fetchall())
    ours = _sorted(tuple(r) for r in spark_df.select(*names).collect())
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows against {len(theirs)}")
    if ours != theirs:
        left, right = set(ours), set(theirs)
        out.append(f"{names}: only ours {sorted(left - right, key=repr)[:3]}, only theirs {sorted(right - left, key=repr)[:3]}; "
                   f"{len(left - right)} / {len(right - left)}")
    return out
