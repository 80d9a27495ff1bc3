"""Measures declared on entities, windowed metrics and validated filters.

An entity is a dict: entity, kind, table, primary_key, dimensions [column, ...],
measures [{name, aggregation, source, filter?, digits?}], joins [{to, column}] where ``column``
of this entity holds the primary key of the entity ``to``.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.periods import WINDOW_NAMES, window_span
from martwright.functions.values import ratio, total, whole, within

# How a measure may aggregate and how a filter may compare.
AGGREGATIONS = ("sum", "count", "min", "max", "avg", "count_distinct")
OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
}


def _join_path(entities: dict[str, dict], start: str, goal: str) -> list[dict]:
    """The declared joins from one entity to another; configuration only, no data."""
    paths = [(start, [])]
    seen = {start}
    while paths:
        here, path = paths.pop(0)
        if here == goal:
            return path
        for step in entities[here].get("joins", []):
            if step["to"] not in seen:
                seen.add(step["to"])
                paths.append((step["to"], [*path, {"from": here, **step}]))
    raise ValueError(f"no declared join from {start} to {goal}")


def _sum(source: Column, wide: str | None) -> Column:
    return F.sum(source) if wide is None else F.sum(source).cast(wide)


def _parts(rows: DataFrame, measure: dict) -> tuple[list[Column], list[Column], Column]:
    """Partial aggregates, how to add them up, and the final value of a measure."""
    name, kind = measure["name"], measure["aggregation"]
    source, scale = F.lit(1), 1.0
    if measure.get("source", "*") != "*":
        source = F.col(measure["source"])
        if kind in ("sum", "avg"):
            source, scale = whole(rows, measure["source"], measure.get("digits"))
    if measure.get("filter"):
        source = F.when(F.expr(measure["filter"]), source)
    # Integers are partial sums per key; what is added up further are decimals.
    wide = "decimal(20,0)" if scale != 1.0 else None
    if kind == "sum":
        value = F.col(name).cast("double") / F.lit(scale)
        return [_sum(source, wide).alias(name)], [F.sum(name).alias(name)], value
    if kind == "count":
        return [F.count(source).alias(name)], [F.sum(name).alias(name)], F.col(name)
    if kind in ("min", "max"):
        pick = F.min if kind == "min" else F.max
        return [pick(source).alias(name)], [pick(name).alias(name)], F.col(name)
    if kind == "avg":
        s, n = f"{name}__sum", f"{name}__n"
        return (
            [_sum(source, wide).alias(s), F.count(source).alias(n)],
            [F.sum(s).alias(s), F.sum(n).alias(n)],
            ratio(F.col(s).cast("double") / F.lit(scale), F.col(n)),
        )
    raise ValueError(f"unknown aggregation {kind} of measure {name}")


def measure_by(
    entities: list[dict],
    tables: dict[str, DataFrame],
    fact: str,
    measures: list[str],
    by: list[str],
) -> DataFrame:
    """Measures of ``fact`` by dimensions written ``entity.column``.

    The fact is summed by its own foreign keys before any join, so the joins see one
    row per key combination: no hot key and no wide shuffle. Distinct counts cannot
    be added up; they are reduced to distinct (keys, source) rows instead.
    """
    known = {e["entity"]: e for e in entities}
    declared = {m["name"]: m for m in known[fact].get("measures", [])}
    unknown = [m for m in measures if m not in declared]
    if unknown:
        raise ValueError(f"no measure {', '.join(unknown)} on {fact}")
    wanted = [declared[m] for m in measures]
    for dimension in by:
        owner, _, column = dimension.partition(".")
        if column not in known[owner]["dimensions"]:
            raise ValueError(f"{dimension} is not a declared dimension")

    paths = [_join_path(known, fact, d.partition(".")[0]) for d in by]
    own = [d.partition(".")[2] for d in by if d.startswith(f"{fact}.")]
    keys = list(dict.fromkeys([p[0]["column"] for p in paths if p] + own))
    rows = tables[known[fact]["table"]]

    distinct = [m for m in wanted if m["aggregation"] == "count_distinct"]
    additive = [m for m in wanted if m not in distinct]
    results = []
    if additive:
        triples = [_parts(rows, m) for m in additive]
        summed = rows.groupBy(*keys).agg(*[c for t in triples for c in t[0]])
        joined, names = _join_dimensions(summed, known, tables, paths, by)
        final = joined.groupBy(*names).agg(*[c for t in triples for c in t[1]])
        results.append(
            final.select(*names, *[t[2].alias(m["name"]) for m, t in zip(additive, triples, strict=True)])
        )
    for m in distinct:
        source = F.col(m["source"])
        held = F.when(F.expr(m["filter"]), source) if m.get("filter") else source
        reduced = rows.select(*keys, held.alias("_held")).distinct()
        joined, names = _join_dimensions(reduced, known, tables, paths, by)
        results.append(joined.groupBy(*names).agg(F.count_distinct("_held").alias(m["name"])))
    names = [c for c in results[0].columns if c not in measures]
    if len(results) == 1:
        return results[0].select(*names, *measures)
    # Each part holds its own measures, one row per group; stacking them needs no join.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    return stacked.groupBy(*names).agg(*[F.max(m).alias(m) for m in measures])


def _join_dimensions(
    summed: DataFrame,
    known: dict[str, dict],
    tables: dict[str, DataFrame],
    paths: list[list[dict]],
    by: list[str],
) -> tuple[DataFrame, list[str]]:
    """Walk the declared paths by left joins, so facts without a match stay in a NULL group."""
    frame, joined = summed, set()
    needed: dict[str, set[str]] = {}
    for path, dimension in zip(paths, by, strict=True):
        owner, _, column = dimension.partition(".")
        if path:
            needed.setdefault(owner, set()).add(column)
        for step in path[1:]:
            needed.setdefault(step["from"], set()).add(step["column"])
        if path:
            for step in path:
                needed.setdefault(step["to"], set())
    for path in paths:
        for position, step in enumerate(path):
            target = known[step["to"]]
            if step["to"] in joined:
                continue
            joined.add(step["to"])
            key = step["column"] if position == 0 else f"{step['from']}__{step['column']}"
            dimension_rows = tables[target["table"]].select(
                F.col(target["primary_key"]).alias(f"_pk_{step['to']}"),
                *[F.col(c).alias(f"{step['to']}__{c}") for c in sorted(needed[step["to"]])],
            )
            frame = frame.join(
                dimension_rows, F.col(key) == F.col(f"_pk_{step['to']}"), "left"
            ).drop(f"_pk_{step['to']}")
    names, columns = [], []
    for path, dimension in zip(paths, by, strict=True):
        owner, _, column = dimension.partition(".")
        name = f"{owner}_{column}"
        names.append(name)
        columns.append(F.col(f"{owner}__{column}" if path else column).alias(name))
    grouped_by = {
        p[0]["column"] if p else d.partition(".")[2] for p, d in zip(paths, by, strict=True)
    }
    return frame.select(*columns, *[c for c in summed.columns if c not in grouped_by]), names


def checked_filter(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Apply filters {column, op, value} after checking column and operator."""
    for entry in filters:
        if entry["column"] not in df.columns:
            raise ValueError(f"unknown column {entry['column']}")
        if entry["op"] not in OPERATORS:
            raise ValueError(f"operator {entry['op']} is not allowed")
        df = df.filter(OPERATORS[entry["op"]](F.col(entry["column"]), entry["value"]))
    return df


def metric_in_windows(
    df: DataFrame, value: str, time_column: str, as_of: date, names: tuple[str, ...] = WINDOW_NAMES
) -> DataFrame:
    """One row per window with its value and rows: one aggregate, a condition per window."""
    spans = {name: within(df, time_column, *window_span(name, as_of)) for name in names}
    sums = [total(df, value, c).alias(f"v_{n}") for n, c in spans.items()]
    rows = [F.count_if(c).alias(f"n_{n}") for n, c in spans.items()]
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("time_window"),
                F.col(f"v_{n}").alias("value"),
                F.col(f"n_{n}").alias("row_count"),
            )
            for n in names
        ]
    )
    return df.agg(*sums, *rows).select(F.inline(entries))


def metric_value(
    df: DataFrame,
    value: str,
    time_column: str,
    window: str,
    as_of: date,
    filters: list[dict] = (),
) -> DataFrame:
    """The value of one window under checked filters; the window prunes the scan."""
    kept = checked_filter(df.filter(within(df, time_column, *window_span(window, as_of))), filters)
    return kept.agg(
        total(kept, value).alias("value"), F.count(F.lit(1)).alias("row_count")
    )


def answer_with_trust(values: DataFrame, latest: DataFrame) -> DataFrame:
    """Value per metric with the status of its latest run.

    ``values`` (metric_name, value) has NULL where the query failed; then the value of
    the latest run is given and marked stale. ``latest`` is one run per metric.
    """
    runs = latest.select(
        "metric_name",
        F.col("status").alias("run_status"),
        F.col("value_sum").cast("double").alias("stored_value"),
        "started_at",
    )
    stale = F.col("value").isNull() & F.col("stored_value").isNotNull()
    return values.join(runs, "metric_name", "left").select(
        "metric_name",
        F.coalesce("value", "stored_value").alias("value"),
        stale.alias("stale"),
        F.when(stale, F.col("started_at")).alias("value_from"),
        F.coalesce("run_status", F.lit("unknown")).alias("trust_status"),
    )
