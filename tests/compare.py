"""Compare a Spark result with DuckDB's answer, order ignored, values and types kept."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(folder: str):
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


KINDS = {"TINYINT": "int", "INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint", "UBIGINT": "ubigint",
         "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
         "BOOLEAN": "boolean"}


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def differences(spark_df, relation) -> list[str]:
    """What differs; empty when both sides agree."""
    names = sorted(spark_df.columns)
    other = dict(zip(relation.columns, map(str, relation.types)))
    found = []
    if names != sorted(other):
        return [f"columns {names} against {sorted(other)}"]
    types = dict(spark_df.dtypes)
    for n in names:
        if KINDS.get(other[n], other[n]) != types[n]:
            found.append(f"type of {n}: {types[n]} against {other[n]}")
    ours = [tuple(normal(r[n]) for n in names) for r in spark_df.collect()]
    place = [list(relation.columns).index(n) for n in names]
    theirs = [tuple(normal(r[i]) for i in place) for r in relation.fetchall()]
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} against {len(theirs)}")
    a, b = sorted(ours, key=key), sorted(theirs, key=key)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} of {len(a)} rows differ, first {names}: {wrong[0][0]} against {wrong[0][1]}")
    return found
