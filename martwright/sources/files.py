"""CSV scans described by an ingest spec.

A spec is a dict: ``source`` {type, path, glob?, multiline?}, ``target`` {table, mode,
primary_key?}, ``columns`` [{name, type}]. Declared columns become the schema;
inference (one more pass over the files) is the fallback.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from martwright.functions.values import instant

# Column type names of an ingest spec and the Spark type of each.
TYPE_NAMES = {
    "VARCHAR": "string",
    "TEXT": "string",
    "JSON": "string",
    "DOUBLE": "double",
    "REAL": "double",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMPTZ": "timestamp",
}


def declared_schema(columns: list[dict[str, str]] | None) -> T.StructType | None:
    """Schema of the ``columns`` block; DECIMAL(p,s) keeps its precision."""
    if not columns:
        return None
    schema = T.StructType()
    for column in columns:
        name = str(column["type"]).strip().upper()
        if name.startswith("DECIMAL"):
            spark_type = name.lower()
        elif name in TYPE_NAMES:
            spark_type = TYPE_NAMES[name]
        else:
            raise ValueError(f"unknown type {column['type']} of column {column['name']}")
        schema = schema.add(column["name"], T.DataType.fromDDL(spark_type))
    return schema


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    glob: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Header CSV from a file, a list of files, a folder or a folder with a file pattern.

    Files stay splittable unless ``multiline`` is asked for.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    frame = reader.csv(path)
    if schema is None:
        # An inferred instant without a zone is a zone-free timestamp.
        stamps = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.TimestampType)]
        frame = frame.withColumns({c: frame[c].cast("timestamp_ntz") for c in stamps})
    return frame


def scan_source(spark: SparkSession, spec: dict) -> DataFrame:
    source = spec["source"]
    if source["type"] != "csv":
        raise NotImplementedError(f"source type '{source['type']}' is not supported, only csv")
    return scan_csv(
        spark,
        source["path"],
        declared_schema(spec.get("columns")),
        source.get("glob"),
        bool(source.get("multiline", False)),
    )


def stamp_loaded(df: DataFrame, as_of: datetime) -> DataFrame:
    """Add the load time (not the time of the source)."""
    return df.withColumn("_loaded_at", instant(as_of))


def target_table(name: str, spec: dict) -> str:
    """The table an ingest loads: the one it names, else ``raw_`` and the ingest's own name."""
    named = spec["target"].get("table") if "target" in spec else None
    return named or f"raw_{name}"
