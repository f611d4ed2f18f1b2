"""Filters of the analytics queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAFFIC_SOURCES = ("view", "click", "signup", "purchase", "error", "legacy")
MOST_DAYS = 365


def time_window(ts: Column, as_of: dt.datetime, days: int = 30, start: dt.datetime | None = None, end: dt.datetime | None = None) -> Column:
    """Half-open window: explicit bounds win, days are held to 1..365, an empty window is an error."""
    days = min(max(days, 1), MOST_DAYS)
    until = end or as_of
    since = start or until - dt.timedelta(days=days)
    if since >= until:
        raise ValueError("the window's start is not before its end")
    return (ts >= F.lit(since.isoformat(" ")).cast("timestamp_ntz")) & (ts < F.lit(until.isoformat(" ")).cast("timestamp_ntz"))


def market_scope(country: Column, chosen: str | None = None, allowed: set[str] | None = None) -> Column:
    """One chosen market, all (None), none (an empty set), or the allowed ones."""
    if chosen:
        return F.upper(country) == chosen.upper()
    if allowed is None:
        return F.lit(True)
    if not allowed:
        return F.lit(False)
    return F.upper(country).isin(sorted(x.upper() for x in allowed))


def traffic(source: Column, chosen: str | None) -> Column:
    if chosen is None:
        return F.lit(True)
    if chosen.lower() not in TRAFFIC_SOURCES:
        raise ValueError(f"unknown traffic source {chosen}")
    return F.lower(source) == chosen.lower()


def feedback_facet(rating: Column, facet: str) -> Column:
    """helpful, not_helpful, unrated or all."""
    kinds = {"helpful": rating > 0, "not_helpful": rating < 0, "unrated": rating.isNull(), "all": F.lit(True)}
    if facet not in kinds:
        raise ValueError(f"unknown feedback facet {facet}")
    return kinds[facet]


def text_search(term: str, *columns: Column) -> Column:
    """Any column contains the term, in lower case; % and _ are wildcards, as in LIKE."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(c).like(f"%{term.lower()}%")
    return found
