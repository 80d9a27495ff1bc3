"""The even split of a difference between two definitions, against all orders of the choices."""

from datetime import date
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from martwright.operators import revenue

MONTH, AS_OF = date(2024, 1, 1), date(2024, 2, 10)
ORDERS = [
    # order_id, status, order_date, amount, amount_local, invoiced_at, paid_at
    (1, "completed", "2024-01-05", 100.0, 90.0, "2024-01-06", "2024-01-07"),
    (2, "completed", "2024-01-20", None, 40.0, "2024-01-21", None),
    (3, "pending", "2024-01-25", 30.0, None, None, None),
    (4, "cancelled", "2024-01-26", 70.0, 70.0, None, None),
    (5, "completed", "2024-02-03", 55.0, None, "2024-02-04", "2024-02-05"),
    (6, "pending", "2024-02-04", None, 20.0, None, None),
    (7, None, "2024-01-08", 11.0, None, None, None),
    (8, "completed", None, 13.0, None, None, None),
    (9, "completed", "2024-01-09", None, None, None, None),
]
REFUNDS = [(1, 10.0), (1, 5.0), (2, 4.0), (3, 3.0), (5, 2.0), (99, 7.0)]
SCHEMA = "order_id int, status string, order_date date, amount double, amount_local double, invoiced_at date, paid_at date"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [[date.fromisoformat(v) if isinstance(v, str) and v[:2] == "20" else v for v in r] for r in ORDERS]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(REFUNDS, "order_id int, refund_amount double")


def value(chosen):
    """Plain value of a hybrid: ``chosen`` maps every choice to the definition it comes from."""
    total = 0.0
    for key, status, day, amount, local, invoiced, paid in ORDERS:
        s, p = chosen["status"], chosen["period"]
        met = status is not None and ((status != s.status) if s.any_other_status else (status == s.status))
        met = met and day is not None and (
            "2024-01-11" <= day if p.rolling_days is not None else "2024-01-01" <= day < "2024-02-01"
        )
        met = met and (chosen["currency"].local_fallback or amount is not None)
        met = met and (not chosen["settlement"].settled_only or (invoiced is not None and paid is not None))
        if met:
            gross = amount if amount is not None or not chosen["currency"].local_fallback else local
            total += gross or 0.0
            if chosen["refunds"].net:
                total -= sum(a for k, a in REFUNDS if k == key)
    return total


def split(definition):
    parts = dict.fromkeys(revenue.SWITCHES, 0.0)
    orders = list(permutations(revenue.SWITCHES))
    for order in orders:
        chosen = dict.fromkeys(revenue.SWITCHES, revenue.ALIGNED)
        for choice in order:
            before = value(chosen)
            chosen = {**chosen, choice: definition}
            parts[choice] += value(chosen) - before
    return {choice: total / len(orders) for choice, total in parts.items()}


@pytest.mark.parametrize("switches", [revenue.SWITCHES, revenue.SWITCHES[::-1]])
def test_shares_equal_the_mean_over_all_orders(tables, switches):
    found = revenue.definition_shares(*tables, MONTH, AS_OF, switches=switches).collect()
    assert len(found) == 15
    for definition in (revenue.ENGINEERING, revenue.ANALYTICS, revenue.FINANCE):
        mine = {r["choice"]: r["delta"] for r in found if r["definition"] == definition.name}
        assert mine == pytest.approx(split(definition))
        whole = value(dict.fromkeys(revenue.SWITCHES, definition)) - value(dict.fromkeys(revenue.SWITCHES, revenue.ALIGNED))
        assert sum(mine.values()) == pytest.approx(whole)


def test_first_and_last_hybrid_are_the_definitions(tables):
    hybrids = revenue.definition_hybrids(*tables, MONTH, AS_OF)
    found = {(r["definition"], r["taken"]): float(r["value"]) for r in hybrids.collect()}
    assert len(found) == 96
    values = revenue.definition_values(*tables, revenue.DEFINITIONS, MONTH, AS_OF).first()
    for name in ("engineering", "analytics", "finance"):
        assert found[name, 0] == pytest.approx(values["aligned"])
        assert found[name, 31] == pytest.approx(values[name])


def test_orders_are_summed_before_the_combinations(tables):
    """The combinations are made of the sums per flags, above the only large shuffle."""
    plan = revenue.definition_hybrids(*tables, MONTH, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    made = next(i for i, line in enumerate(lines) if "explode(" in line)
    assert any("Aggregate" in line and "own_status" in line for line in lines[made:])


def test_no_orders_and_wrong_switches(tables):
    orders, refunds = tables
    none = revenue.definition_shares(orders.filter(F.lit(False)), refunds, MONTH, AS_OF)
    assert none.collect() == []
    with pytest.raises(ValueError, match="switches"):
        revenue.definition_shares(orders, refunds, MONTH, AS_OF, switches=("status",))
