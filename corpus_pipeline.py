"""From raw documents to a training mix, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows and keeps all columns of ``docs``, whatever
their names; only the last one adds columns. Null and empty texts, repeated rows, null ids and empty tables go
through as each operator defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.llm import dartminhash, factors, latent, mixing, secretscan
from martwright.llm.common import cut_lineage, document_keys, open_table
from martwright.llm.queries import quality_model, secret_model

ORACLE_SQL = None
KEY = ["k1", "k2"]


def _keys(docs: DataFrame):
    return document_keys(F.col("doc_id"), F.col("text"), docs.schema["doc_id"].dataType)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2): the whole row in one column, so that no name can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs))


def _numbered(keyed: DataFrame, order) -> DataFrame:
    """Adds ``turn``, which tells repeated rows apart."""
    return keyed.withColumn("turn", F.row_number().over(Window.partitionBy(*KEY).orderBy(order)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_model(docs, open_table(spark, sf_dir, "labels"))
    scored = factors.score(docs, model, carry={"row": F.struct(*docs.columns)})
    return scored.where("score >= 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-copies: the one with the smallest id."""
    classes = dartminhash.near_duplicates(docs)
    kept = classes.groupBy("class_key", (F.col("n_words") > 0).alias("worded")).agg(
        F.min(F.struct("k2", "k1")).alias("kept")
    )
    kept = cut_lineage(kept.select("kept.k1", "kept.k2"))
    rows = _keyed(docs).join(kept, KEY, "left_semi")
    return _numbered(rows, F.lit(0)).where("turn = 1").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark text."""
    found = latent.leaks(docs, open_table(spark, sf_dir, "benchmark"))
    leaked = cut_lineage(found.select(*KEY).distinct())
    return _keyed(docs).join(leaked, KEY, "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secretscan.redact(docs, secret_model(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each, repeats counted.

    Adds mix_size, mix_target and mix_taken; a name that ``docs`` has already gets underscores.
    """
    mixed = mixing.mix(docs, carry=_keys(docs)).where("taken > 0")
    shares = _numbered(mixed.select(*KEY, "size", "target", "taken"), F.desc("taken"))
    added = []
    for name in ("size", "target", "taken"):
        free = f"mix_{name}"
        while free in docs.columns:
            free += "_"
        added.append(F.col(name).alias(free))
    return (
        _numbered(_keyed(docs), F.lit(0)).join(shares, [*KEY, "turn"]).select("row.*", *added)
    )


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
