"""URL filter over dated list entries.

An entry says that from a day on a key is blocked, allowed, or no longer listed. Entries of a key
become validity intervals; every capture is joined to the intervals that hold on the day
it was fetched. A key is a host (it covers its subdomains) or a host with a path prefix of
whole segments; the most specific key decides (longer path first, then the longer host).

Defined results: a null or malformed URL, a null day and a capture no key covers give
action null and blocked false; of several entries for one key and day the one with the larger
``seq`` holds; repeated captures give repeated rows; empty tables give empty results.
Other columns of either input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    """The path without its leading and trailing slashes."""
    return F.btrim(F.regexp_extract(url, PATH, 1), F.lit("/"))


def keys_of(url: Column) -> Column:
    """All (key, rank) that could list the URL: host suffixes, host with path prefixes."""
    labels = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"),
            F.lit(0).alias("depth"),
        ),
    )
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.struct(
                F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias(
                    "key"
                ),
                i.alias("depth"),
            ),
        ),
    )
    return F.when(
        host_of(url) != "",
        F.concat(suffixes, F.coalesce(prefixes, F.slice(suffixes, 1, 0))),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, first_day, end_day) of entries (key, day, seq, action); end_day is open."""
    order = Window.partitionBy("key").orderBy("day", "seq")
    return (
        entries.where(F.col("key").isNotNull() & F.col("day").isNotNull())
        .select("key", "day", "seq", "action")
        .withColumn("end_day", F.lead("day").over(order))
        .where(F.col("action").isin("block", "allow"))
        .where(F.col("end_day").isNull() | (F.col("end_day") > F.col("day")))
        .select("key", "action", F.col("day").alias("first_day"), "end_day")
    )


def evaluate(
    captures: DataFrame,
    entries: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    day_col: str = "fetch_day",
) -> DataFrame:
    """One row per capture: id, url, day, matched_key, action, blocked.

    Equal captures are counted first and written out again at the end. A capture
    becomes one row per key that could list it; those rows meet the intervals by
    key, and a capture's matches meet again by its own values, so a hot host only ever makes the key
    join uneven, where the list side of one key is a handful of intervals.
    """
    seen = (
        captures.select(
            F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).alias("day")
        )
        .groupBy("id", "url", "day")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    listed = intervals(entries)
    probes = seen.select("*", F.explode_outer(keys_of(F.col("url"))).alias("probe")).select(
        "id", "url", "day", "copies", "probe.key", "probe.depth"
    )
    hit = (
        (probes["key"] == listed["key"])
        & (probes["day"] >= listed["first_day"])
        & (listed["end_day"].isNull() | (probes["day"] < listed["end_day"]))
    )
    best = (
        probes.join(listed, hit, "left")
        .select(
            "id",
            "url",
            "day",
            "copies",
            F.when(
                F.col("action").isNotNull(),
                F.struct(
                    probes["depth"],
                    F.length(probes["key"]).alias("length"),
                    probes["key"].alias("key"),
                    "action",
                ),
            ).alias("match"),
        )
        .groupBy("id", "url", "day", "copies")
        .agg(F.max("match").alias("match"))
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("day").alias(day_col),
        F.col("match.key").alias("matched_key"),
        F.col("match.action").alias("action"),
        F.coalesce(F.col("match.action") == "block", F.lit(False)).alias("blocked"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
