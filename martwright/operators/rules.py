"""Metric contracts: reading the trust rules of a contract into flat rule rows.

A contract is a dict: metric, description, owner, tags, sources, table, value_column,
time_column and ``trust``, a list of one-key mappings such as
``{"null_rate": {"column": "amount", "max": "1%"}}``. With ``digits`` floating values
are summed exactly in units of that many decimal places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from martwright.functions.periods import grain_of, hours_of, number_of

# Rule types and the thresholds a contract without rules gets.
RULE_TYPES = (
    "freshness",
    "null_rate",
    "volume",
    "range",
    "change",
    "duplicate_rate",
    "schema_drift",
    "distribution_shift",
    "row_count",
    "trailing_average",
)
DEFAULT_TRUST = (
    {"freshness": {"max": "24 hours"}},
    {"null_rate": {"max": "5%"}},
    {"volume": {"max_drop": "25%", "period": "day over day"}},
)

RULE_SCHEMA = (
    "metric string, rule_type string, column_name string, table_name string,"
    " min double, max double, warn double, period string, digits int"
)


@dataclass(frozen=True)
class Rule:
    metric: str
    rule_type: str
    column_name: str | None
    table_name: str
    min: float | None
    max: float | None
    warn: float | None
    period: str | None
    digits: int | None


def rules_of(contract: dict, defaults: Sequence[dict] = DEFAULT_TRUST) -> list[Rule]:
    """Flat rules of one contract, ``defaults`` when it has none."""
    return [_rule(contract, entry) for entry in contract.get("trust") or defaults]


def _rule(contract: dict, entry: dict) -> Rule:
    ((kind, body),) = entry.items()
    if kind not in RULE_TYPES:
        raise ValueError(f"unknown rule {kind} in {contract['metric']}")
    body = body or {}
    value, stamp = contract.get("value_column", "amount"), contract.get("time_column", "updated_at")
    column = {
        "freshness": body.get("column", stamp),
        "null_rate": body.get("column", value),
        "range": value,
        "change": value,
        "trailing_average": value,
    }.get(kind, body.get("column"))
    read = hours_of if kind == "freshness" else number_of
    limit = body.get("max", body.get("max_drop"))
    period = grain_of(body["period"]) if "period" in body else None
    if kind == "trailing_average":
        period = f"{int(body.get('days', 30))} days"
    return Rule(
        contract["metric"],
        kind,
        column,
        body.get("table") or contract["table"],
        None if body.get("min") is None else number_of(body["min"]),
        None if limit is None else read(limit),
        None if body.get("warn") is None else read(body["warn"]),
        period,
        contract.get("digits"),
    )


def rule_rows(spark: SparkSession, contracts: list[dict]) -> DataFrame:
    """One row per rule over all contracts."""
    rows = [tuple(asdict(r).values()) for c in contracts for r in rules_of(c)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def catalog_rows(spark: SparkSession, contracts: list[dict]) -> DataFrame:
    """One row per contract header."""
    rows = [
        (
            c["metric"],
            c.get("description"),
            c.get("owner"),
            c.get("tags", []),
            c.get("sources", [c["table"]]),
            len(rules_of(c)),
        )
        for c in contracts
    ]
    return spark.createDataFrame(
        rows,
        "metric string, description string, owner string, tags array<string>,"
        " sources array<string>, rules int",
    )
