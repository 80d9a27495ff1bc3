"""Side-by-side comparison of a Spark result and its SQL form in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=_key)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=_key)
    return [names[i] for i in order], rows


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "boolean": "BOOLEAN",
}


def type_differences(df, con, sql):
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for field in df.schema.fields:
        mine = SPARK_TO_DUCK.get(field.dataType.simpleString(), field.dataType.simpleString())
        if duck.get(field.name) != mine:
            out.append((field.name, mine, duck.get(field.name)))
    return out
