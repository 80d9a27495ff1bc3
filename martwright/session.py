"""Session, table access and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants; sizes that depend on the cluster stay with the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
    # A suite runs many different queries again and again: keep their compiled stages.
    "spark.sql.codegen.cache.maxEntries": "4000",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "martwright", master: str | None = None, **conf: str) -> SparkSession:
    """Create or get a session; pass extra settings with dots as ``**{"spark.x": "y"}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Declared schemas of the given tables: opening one needs no job that reads footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def read_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with the columns and types its files carry, whatever was declared."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder all executors can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder on this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.mkdtemp(prefix="martwright-"), purpose)


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path`` and a function that names places in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


# Paths of the tables that cut_lineage wrote in the innermost scope of this thread; None outside.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that ``cut_lineage`` writes inside, also those of failed writes.

    Without a scope these tables stay until the shared folder is cleaned. Write or collect every
    result inside: a frame made of such a table cannot be read afterwards. Scopes nest, and each removes
    what was written directly in it. Other threads' tables, and folders of other purposes, are left alone.
    """
    written: list[str] = []
    outer = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(outer)
        for path in written:
            fs, at = file_system(spark, path)
            fs.delete(at(path), True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, safe when executors are lost."""
    path = scratch_dir(df.sparkSession, "cut")
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
