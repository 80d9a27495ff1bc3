"""Calendar periods and named time windows."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

# The closed list of window names a metric question may use.
WINDOW_NAMES = (
    "current_day",
    "yesterday",
    "last_7_days",
    "last_30_days",
    "current_week",
    "last_week",
    "current_month",
    "last_month",
    "mtd",
    "current_quarter",
    "last_quarter",
    "qtd",
    "current_year",
    "last_year",
    "ytd",
    "current_period",
    "last_period",
    "all_time",
)

Span = tuple[date | None, date | None]


def as_day(value: date) -> date:
    return value.date() if isinstance(value, datetime) else value


def add_months(day: date, months: int) -> date:
    """First day of the month ``months`` away from the month of ``day``."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def period_start(day: date, grain: str) -> date:
    if grain == "day":
        return day
    if grain == "week":
        return day - timedelta(days=day.weekday())
    if grain == "month":
        return day.replace(day=1)
    if grain == "quarter":
        return date(day.year, 3 * ((day.month - 1) // 3) + 1, 1)
    if grain == "year":
        return date(day.year, 1, 1)
    raise ValueError(f"unknown period: {grain}")


def shift_period(start: date, grain: str, steps: int) -> date:
    if grain in ("day", "week"):
        return start + timedelta(days=steps * (7 if grain == "week" else 1))
    return add_months(start, steps * {"month": 1, "quarter": 3, "year": 12}[grain])


def period_span(as_of: date, grain: str, steps: int = 0) -> Span:
    """The calendar period that holds ``as_of``, moved by ``steps`` periods."""
    start = shift_period(period_start(as_day(as_of), grain), grain, steps)
    return start, shift_period(start, grain, 1)


def window_span(name: str, as_of: date) -> Span:
    """Half-open span of a named window; ``all_time`` has no bounds.

    ``last_N_days`` ends before ``as_of``, the to-date windows include it.
    """
    today = as_day(as_of)
    tomorrow = today + timedelta(days=1)
    if name == "all_time":
        return None, None
    if name == "current_day":
        return today, tomorrow
    if name == "yesterday":
        return today - timedelta(days=1), today
    days = re.fullmatch(r"last_(\d+)_days", name)
    if days:
        return today - timedelta(days=int(days.group(1))), today
    to_date = {"mtd": "month", "qtd": "quarter", "ytd": "year"}
    if name in to_date:
        return period_start(today, to_date[name]), tomorrow
    which, _, grain = name.partition("_")
    grain = "month" if grain == "period" else grain
    if which in ("current", "last") and grain in ("week", "month", "quarter", "year"):
        return period_span(today, grain, 0 if which == "current" else -1)
    raise ValueError(f"unknown window: {name}")


def grain_of(period: str) -> str:
    """``day over day`` -> ``day``."""
    grain = period.strip().split()[0].lower()
    if grain not in ("day", "week", "month"):
        raise ValueError(f"unknown comparison period: {period}")
    return grain


def hours_of(text: str | float) -> float:
    """``6 hours`` -> 6.0; a bare number is hours."""
    if isinstance(text, int | float):
        return float(text)
    amount, _, unit = text.strip().partition(" ")
    scale = {"minute": 1 / 60, "hour": 1.0, "day": 24.0}
    unit = (unit.strip().lower() or "hours").rstrip("s")
    if unit not in scale:
        raise ValueError(f"unknown duration: {text}")
    return float(amount) * scale[unit]


def number_of(text: str | float) -> float:
    """``1%``, ``100,000`` or a plain number; percents stay on the 0-100 scale."""
    if isinstance(text, int | float):
        return float(text)
    return float(text.strip().rstrip("%").replace(",", ""))
