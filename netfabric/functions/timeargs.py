"""Time arguments: ``now``, ``now-<n>[smhd]`` or ISO-8601, against an explicit ``as_of``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
_RELATIVE = re.compile(r"now(?:-(?P<amount>\d+)(?P<unit>[smhd]))?")


class TimeArgError(ValueError):
    """The expression is neither relative nor ISO-8601."""


def _utc(value: datetime) -> datetime:
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def parse_time(value: str | datetime, as_of: str | datetime | None = None) -> datetime:
    """Resolve a time expression to an aware UTC datetime; naive input means UTC."""
    if isinstance(value, datetime):
        return _utc(value)
    expr = value.strip()
    relative = _RELATIVE.fullmatch(expr)
    if relative:
        base = datetime.now(timezone.utc) if as_of is None else parse_time(as_of)
        if relative["amount"] is None:
            return base
        return base - timedelta(**{_UNITS[relative["unit"]]: int(relative["amount"])})
    try:
        return _utc(datetime.fromisoformat(expr.replace("Z", "+00:00")))
    except ValueError as exc:
        raise TimeArgError(f"unrecognized time expression: {value!r}") from exc


def time_lit(value: str | datetime, as_of: str | datetime | None = None) -> Column:
    """A TIMESTAMP literal, so that filters on it can be pushed into the scan."""
    return ts_lit(parse_time(value, as_of))


def ts_lit(moment: datetime) -> Column:
    return F.lit(_utc(moment).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def window_filter(
    ts: str, since: str | datetime, until: str | datetime | None, as_of: str | datetime | None,
    inclusive_end: bool = True, date_column: str | None = None,
) -> Column:
    """Time-window predicate; with ``date_column`` it also prunes day partitions."""
    lo = parse_time(since, as_of)
    cond = F.col(ts) >= ts_lit(lo)
    if date_column:
        cond = cond & (F.col(date_column) >= F.lit(lo.date()))
    if until is not None:
        hi = parse_time(until, as_of)
        cond = cond & ((F.col(ts) <= ts_lit(hi)) if inclusive_end else (F.col(ts) < ts_lit(hi)))
        if date_column:
            cond = cond & (F.col(date_column) <= F.lit(hi.date()))
    return cond
