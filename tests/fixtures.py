"""Input rows with known results. Rows and results that have to be matched."""

from datetime import date, datetime
from decimal import Decimal

NOW = datetime(2026, 4, 6, 0, 0)

# Five orders, one without an amount.
ORDERS = [
    (1, 100.00, 0.0, "completed", date(2026, 4, 1), datetime(2026, 4, 5, 12)),
    (2, 250.50, 10.0, "completed", date(2026, 4, 2), datetime(2026, 4, 5, 12)),
    (3, None, 0.0, "pending", date(2026, 4, 3), datetime(2026, 4, 5, 12)),
    (4, 75.25, 5.0, "completed", date(2026, 4, 4), datetime(2026, 4, 5, 12)),
    (5, 500.00, 0.0, "refunded", date(2026, 4, 5), datetime(2026, 4, 5, 12)),
]
ORDERS_SCHEMA = (
    "order_id int, amount double, refund double, status string, order_date date,"
    " updated_at timestamp_ntz"
)

MARCH = date(2026, 3, 1)
REPORT_DAY = date(2026, 4, 2)


def _d(value):
    return None if value is None else Decimal(value)


# Eight orders and two refunds on which four definitions of revenue differ.
ALIGNMENT = [
    (order, _d(local), currency, _d(amount), status, day, settled, settled, datetime(2026, 4, 1, 23))
    for order, local, currency, amount, status, day, settled in [
        ("O-001", 1000000, "USD", 1000000, "completed", date(2026, 3, 5), datetime(2026, 3, 6)),
        ("O-002", 800000, "USD", 800000, "completed", date(2026, 3, 12), datetime(2026, 3, 13)),
        ("O-003", 1200000, "USD", 1200000, "completed", date(2026, 3, 20), datetime(2026, 3, 21)),
        ("O-004", 500000, "USD", 500000, "completed", date(2026, 3, 28), None),
        ("O-005", 300000, "EUR", None, "completed", date(2026, 3, 15), datetime(2026, 3, 16)),
        ("O-006", 400000, "USD", 400000, "cancelled", date(2026, 3, 18), None),
        ("O-007", 600000, "USD", 600000, "pending", date(2026, 3, 30), None),
        ("O-008", 250000, "USD", 250000, "completed", date(2026, 4, 1), datetime(2026, 4, 1)),
    ]
]
ALIGNMENT_SCHEMA = (
    "order_id string, amount_local decimal(12,2), currency string, amount decimal(12,2),"
    " status string, order_date date, invoiced_at timestamp_ntz, paid_at timestamp_ntz,"
    " updated_at timestamp_ntz"
)
REFUNDS = [("O-002", Decimal(200000)), ("O-001", Decimal(50000))]
REFUNDS_SCHEMA = "order_id string, refund_amount decimal(12,2)"


def _sub(name, plan, amount, interval, status, started, canceled=None, period_end="2025-04-15"):
    at = datetime.fromisoformat
    return (
        name,
        plan,
        Decimal(amount),
        interval,
        status,
        at(started),
        canceled and at(canceled),
        at(period_end),
    )


# Subscriptions of March 2025: (plan, monthly price) by status.
SUBSCRIPTIONS = [
    _sub("sub_001", "professional", "79.00", "monthly", "active", "2024-06-15"),
    _sub("sub_002", "starter", "29.00", "monthly", "active", "2024-08-01"),
    _sub("sub_003", "enterprise", "299.00", "monthly", "active", "2024-03-10"),
    _sub("sub_004", "professional", "79.00", "monthly", "active", "2024-09-20"),
    _sub("sub_005", "starter", "29.00", "monthly", "active", "2024-11-05"),
    _sub("sub_006", "professional", "79.00", "monthly", "active", "2025-01-10"),
    _sub("sub_007", "enterprise", "299.00", "monthly", "active", "2024-07-22"),
    _sub("sub_008", "starter", "29.00", "monthly", "active", "2025-02-01"),
    _sub("sub_009", "professional", "79.00", "monthly", "active", "2024-12-15"),
    _sub("sub_010", "enterprise", "299.00", "monthly", "active", "2024-10-01"),
    _sub("sub_011", "professional", "66.58", "annual", "active", "2024-04-01"),
    _sub("sub_012", "enterprise", "249.17", "annual", "active", "2024-05-15"),
    _sub("sub_013", "starter", "24.17", "annual", "active", "2024-09-01"),
    _sub("sub_014", "professional", "79.00", "monthly", "past_due", "2024-08-10"),
    _sub("sub_015", "starter", "29.00", "monthly", "past_due", "2024-11-20"),
    _sub("sub_016", "starter", "29.00", "monthly", "canceled", "2024-07-01", "2025-03-05"),
    _sub("sub_017", "professional", "79.00", "monthly", "canceled", "2024-10-15", "2025-03-18"),
    _sub("sub_018", "enterprise", "299.00", "monthly", "canceled", "2024-06-01", "2025-03-25"),
    _sub("sub_019", "starter", "29.00", "monthly", "canceled", "2024-09-10", "2025-02-12"),
    _sub("sub_020", "professional", "79.00", "monthly", "canceled", "2024-04-20", "2025-02-28"),
    _sub("sub_021", "trial", "0.00", "monthly", "trialing", "2025-03-20"),
    _sub("sub_022", "trial", "0.00", "monthly", "trialing", "2025-03-22"),
    _sub("sub_023", "starter", "29.00", "monthly", "expired", "2024-05-01", None, "2025-03-01"),
    _sub("sub_024", "professional", "79.00", "monthly", "expired", "2024-08-15", None, "2025-02-15"),
]
SUBSCRIPTIONS_SCHEMA = (
    "subscription_id string, plan_name string, plan_amount decimal(10,2),"
    " billing_interval string, status string, started_at timestamp_ntz,"
    " canceled_at timestamp_ntz, current_period_end timestamp_ntz"
)
