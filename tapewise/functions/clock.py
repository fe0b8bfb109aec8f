"""Local clocks, session maps and time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK, CHICAGO = "America/New_York", "America/Chicago"

#: Fixed values: (label, first minute, end minute) of the local day, end exclusive; a band over midnight has two lines.
SESSION_MAPS = {
    "seven": (("Asia", 18 * 60, 24 * 60), ("Asia", 0, 120), ("London", 120, 480), ("PreM", 480, 570), ("AM", 570, 720), ("Lunch", 720, 810), ("PM", 810, 960), ("AH", 960, 1080)),
    "utc_trade": (("london", 420, 780), ("ny", 780, 1260)),
    "utc_thirds": (("asia", 0, 420), ("london", 420, 780)),
    "utc_chains": (("asia", 0, 420), ("london", 420, 780), ("ny", 780, 1260)),
    "kill_zones": (("london", 120, 300), ("ny_am", 420, 660), ("ny_pm", 810, 960)),
    "ny_halves": (("Asia", 18 * 60, 24 * 60), ("Asia", 0, 120), ("London", 120, 480), ("NY_AM", 480, 720), ("NY_PM", 720, 960)),
    "settlement": (
        ("globex_abend", 18 * 60, 24 * 60), ("asia_london", 0, 300), ("pre_market", 300, 540), ("rth_am", 540, 720), ("rth_lunch", 720, 840), ("rth_pm", 840, 960), ("settlement_hour", 960, 1080),
    ),
    "utc_filter": (("asia", 60, 240), ("london", 420, 660), ("ny", 810, 960)),
    "level": (("Overnight", 18 * 60, 24 * 60), ("Overnight", 0, 120), ("London", 120, 570), ("NY Open", 570, 720), ("Lunch", 720, 810), ("PM", 810, 960)),
}
OTHERWISE = {"seven": "Other", "utc_trade": "asia", "utc_thirds": "ny", "utc_chains": "post", "kill_zones": None, "ny_halves": "Post", "settlement": "unknown", "utc_filter": None, "level": None}
#: Hours of the day in New York, end exclusive.
ASIA, LONDON, NY = (19, 4), (2, 11), (8, 17)


def local(ts: Column | str, zone: str = NEW_YORK) -> Column:
    """Wall clock in a zone of a UTC timestamp; daylight saving by the zone's rules."""
    return F.from_utc_timestamp(ts, zone)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def session_map(ts: Column, name: str) -> Column:
    """Label of a local timestamp under one of SESSION_MAPS."""
    minute, out = minute_of_day(ts), F.lit(OTHERWISE[name]).cast("string")
    for label, first, end in reversed(SESSION_MAPS[name]):
        out = F.when((minute >= first) & (minute < end), F.lit(label)).otherwise(out)
    return out


def in_session(ts: Column, session: str) -> Column:
    """Whether a UTC time lies in a session of the map utc_filter; 'all' and unknown names let everything pass."""
    known = {label for label, _, _ in SESSION_MAPS["utc_filter"]}
    return F.coalesce(session_map(ts, "utc_filter") == session, F.lit(False)) if session in known else F.lit(True)


def in_hours(ts: Column, band: tuple[int, int]) -> Column:
    """Whether the local hour lies in [first, end), over midnight if end < first."""
    first, end = band
    hour = F.hour(ts)
    return (hour >= first) & (hour < end) if first < end else (hour >= first) | (hour < end)


def session_name(ts: Column) -> Column:
    """asia, london, ny, 'overlap' for two at once, '' for none, of a New York timestamp."""
    flags = [("asia", in_hours(ts, ASIA)), ("london", in_hours(ts, LONDON)), ("ny", in_hours(ts, NY))]
    count = sum((f.cast("int") for _, f in flags[1:]), flags[0][1].cast("int"))
    out = F.lit("")
    for label, f in reversed(flags):
        out = F.when(f, F.lit(label)).otherwise(out)
    return F.when(count > 1, F.lit("overlap")).otherwise(out)


def trading_weekday(ts: Column) -> Column:
    """Weekday of the trading day (0 Monday): from 18:00 on it is the next day's."""
    return F.weekday(ts + F.expr("INTERVAL 6 HOURS"))


def bucket_label(ts: Column, minutes: int) -> Column:
    """HH:MM of the start of the bucket of so many minutes."""
    start = F.floor(minute_of_day(ts) / minutes) * minutes
    return F.format_string("%02d:%02d", F.floor(start / 60).cast("int"), (start % 60).cast("int"))


def stamp(ts: Column | str) -> Column:
    """A timestamp as text, the form in which results carry it."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
