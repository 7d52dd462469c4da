"""Tolerant dates, and windows back from now."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried after ISO, in order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy")
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_date(raw: Column, now: Column) -> Column:
    """A timestamp from ISO or one of FORMATS, naive ones as UTC; null before 1990 or over a year from now."""
    text = F.trim(raw)
    iso = F.when(text.rlike(ISO), F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    parsed = F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])
    return F.when((F.year(parsed) >= 1990) & (parsed <= now + F.make_interval(days=F.lit(365))), parsed)


def since_cutoff(text: str, now: datetime.datetime) -> datetime.datetime:
    """The moment that "2 weeks" or an ISO date means, in UTC; months have 30 days and years 365."""
    raw = text.strip().lower()
    if m := re.fullmatch(r"(\d+)\s+(day|week|month|year)s?", raw):
        return now - datetime.timedelta(days=int(m[1]) * DAYS[m[2]])
    try:
        found = datetime.datetime.fromisoformat(raw)
    except ValueError:
        raise ValueError(f"no time span and no date: {text!r}") from None
    return (found if found.tzinfo else found.replace(tzinfo=datetime.UTC)).astimezone(datetime.UTC)


def recent_since(text: str | None, now: datetime.datetime, most_days: int = 3650) -> datetime.datetime | None:
    """A cutoff that a model proposed: an ISO date neither ahead of now nor older than most_days; else none."""
    try:
        found = datetime.datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except (ValueError, AttributeError):
        return None
    found = found if found.tzinfo else found.replace(tzinfo=datetime.UTC)
    return found if now - datetime.timedelta(days=most_days) <= found <= now else None
