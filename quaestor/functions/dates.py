"""Deadlines as Column functions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Africa/Casablanca"
NOW = "2026-01-15 12:00:00"


def parse_deadline(text: Column) -> Column:
    """``d/M/yyyy H:m`` or ``d/M/yyyy`` in Moroccan local time as epoch seconds; else null."""
    bare = F.trim(text)
    timed = F.when(bare.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"), F.try_to_timestamp(bare, F.lit("d/M/yyyy H:m")))
    dated = F.when(bare.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(bare, F.lit("d/M/yyyy")))
    return F.unix_seconds(F.to_utc_timestamp(F.coalesce(timed, dated), ZONE))


def now_seconds(now: str = NOW) -> int:
    import datetime as dt

    return int(dt.datetime.fromisoformat(now).replace(tzinfo=dt.timezone.utc).timestamp())


def active(deadline: Column, now: str = NOW) -> Column:
    """Deadline known and after ``now`` (strictly)."""
    return F.coalesce(deadline > F.lit(now_seconds(now)), F.lit(False))


def shown_deadline(text: Column, zone: str = ZONE) -> Column:
    """Epoch seconds of the deadline as pages show it: the first date in the text, at 23:59 without a time; else null.

    Days and months beyond the calendar run over into what follows. The zone's offset is the
    one at the clock time taken as UTC.
    """
    part = lambda k: F.regexp_extract(text, r"(\d{2})/(\d{2})/(\d{4})(?:\s+(\d{2}):(\d{2}))?", k)
    number = lambda k, missing: F.when(part(k) == "", F.lit(missing)).otherwise(part(k).try_cast("int"))
    start = F.add_months(F.make_date(part(3).try_cast("int"), F.lit(1), F.lit(1)), number(2, 1) - 1)
    guess = (F.unix_date(start) + number(1, 1) - 1).cast("long") * 86400 + number(4, 23) * 3600 + number(5, 59) * 60
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(guess), zone))
    return F.when(part(3) != "", 2 * guess - local)


def days_left(deadline: Column, now: str = NOW) -> Column:
    return F.ceil((deadline - F.lit(now_seconds(now))) / F.lit(86400)).cast("int")


# From how many days left which words and tone are shown.
LAST_DAY, WARNED, COUNTED = 1, 7, 30


def urgency(days: Column) -> Column:
    """The words beside a deadline in a list; empty where it is far off or unknown."""
    counted = F.concat(days.cast("string"), F.lit(" jours restants"))
    return F.when(days <= LAST_DAY, "Dernier jour").when(days <= COUNTED, counted).otherwise("")


def urgency_detail(days: Column) -> Column:
    """The words beside the deadline of one offer; empty where it is unknown."""
    return F.when(days.isNull(), "").when(days > COUNTED, "Offre active").otherwise(urgency(days))


def tone(days: Column) -> Column:
    return F.when(days <= LAST_DAY, "chip-error").when(days <= WARNED, "chip-warning").when(days.isNotNull(), "chip-neutral")


def duration(started: Column, finished: Column, now: Column) -> Column:
    """Seconds from start to end, or to now while running, to a tenth (half to even); null before the start."""
    return F.bround(F.coalesce(finished, now) - started, 1)
