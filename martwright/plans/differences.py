"""Two stored tables compared by their digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators.differences import difference, stored_difference
from martwright.plans import views
from martwright.plans.ingest import FIRST
from martwright.plans.registry import query
from martwright.session import read_table, scratch_dir
from martwright.sources.files import stamp_loaded
from martwright.sources.load import load

BUCKETS = 16


@query("""
WITH l AS (SELECT * FROM orders WHERE o_orderkey % 4999 <> 7),
r AS (SELECT o_orderkey, o_custkey,
             CASE WHEN o_orderkey % 3989 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 3001 = 5 OR o_orderkey % 3989 = 3 THEN NULL ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderkey % 4001 <> 11)
SELECT COALESCE(l.o_orderkey, r.o_orderkey) AS o_orderkey,
       CASE WHEN r.o_orderkey IS NULL THEN 'left only' WHEN l.o_orderkey IS NULL THEN 'right only'
            ELSE 'changed' END AS side,
       CASE WHEN l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL THEN
            concat_ws(',', CASE WHEN l.o_orderstatus IS DISTINCT FROM r.o_orderstatus THEN 'o_orderstatus' END,
                           CASE WHEN l.o_totalprice IS DISTINCT FROM r.o_totalprice THEN 'o_totalprice' END)
            ELSE '' END AS columns
FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey
WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus
   OR l.o_totalprice IS DISTINCT FROM r.o_totalprice
""")
def table_difference(spark: SparkSession, root: str) -> DataFrame:
    """Orders against a copy with a few rows lost, added and changed."""
    folder = scratch_dir(spark, "table_difference")
    key = F.col("o_orderkey")
    orders = read_table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = orders.withColumns(
        {
            "o_orderstatus": F.when(key % 3989 == 3, "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(~((key % 3001 == 5) | (key % 3989 == 3)), F.col("o_totalprice")),
        }
    )
    sides = {"left": orders.where(key % 4999 != 7), "right": changed.where(key % 4001 != 11)}
    for name, rows in sides.items():
        load(
            stamp_loaded(rows, FIRST), f"{folder}/{name}", "replace", primary_key=["o_orderkey"], buckets=BUCKETS
        )
    found = stored_difference(spark, f"{folder}/left", f"{folder}/right", ["o_orderkey"], BUCKETS)
    return found.rows.select("o_orderkey", "side", F.array_join("columns", ",").alias("columns"))


@query("""
SELECT 'right only' AS side, COUNT(*) AS documents FROM documents
WHERE NOT (length(text) >= 200) OR length(text) IS NULL
UNION ALL
SELECT 'changed', COUNT(*) FROM documents WHERE length(text) >= 200 AND source IS NOT NULL AND lang = 'de'
""")
def document_difference(spark: SparkSession, root: str) -> DataFrame:
    """Documents against a cleaned copy: short ones are gone, one language lost its source."""
    docs = views.read_table(spark, root, "documents")
    cleaned = docs.where(F.length("text") >= 200).withColumn(
        "source", F.when(F.col("lang").eqNullSafe("de"), None).otherwise(F.col("source"))
    )
    found = difference(cleaned, docs, ["doc_id"])
    counts = found.rows.groupBy("side").agg(F.count(F.lit(1)).alias("documents"))
    sides = spark.createDataFrame([("right only",), ("changed",)], "side string")
    return sides.join(counts, "side", "left").select("side", F.coalesce("documents", F.lit(0)).alias("documents"))
