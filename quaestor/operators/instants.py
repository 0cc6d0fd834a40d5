"""Mixed timestamp formats and zones to one UTC instant.

A value is read by one of a few patterns into local clock fields plus a zone (an IANA
name, a fixed offset, or the field's default zone). Local times of named zones are then
matched as of their place in the zone's offset history: each zone is a sequence of
offset intervals, and an interval covers a stretch of local clock time. Two intervals over
one local time mean it was repeated, none that it was skipped, one gives its offset. The
stretches are cut beforehand into disjoint segments, exploded by local year, so that the
as-of join is an equi-join on (zone, year) with exactly one segment per row. Segments cover
FIRST_YEAR to LAST_YEAR; before, every zone keeps its first offset, and after, rules repeat
with the calendar, so a later year is looked up in a covered one of the same calendar.

Defined results: null and empty values give no row in ``cases``; Arabic-Indic digits are read
as ASCII ones, but are not house form; blanks only, words, impossible dates and unknown zones
are ``unreadable``; a repeated local time is the earlier instant, a skipped one keeps the
offset in force before the gap; fractions are dropped (towards the past); repeated rows give
repeated results in ``to_instants`` and one in ``cases``; extra columns are kept and never read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names as written in French, Arabic (Maghreb), English and Spanish.
MONTHS = {
    1: "janvier janv january jan يناير enero ene",
    2: "février fevrier févr fevr february feb فبراير febrero",
    3: "mars march mar مارس marzo",
    4: "avril avr april apr أبريل ابريل abril abr",
    5: "mai may ماي mayo",
    6: "juin june jun يونيو junio",
    7: "juillet juil july jul يوليوز يوليو julio",
    8: "août aout august aug غشت agosto ago",
    9: "septembre sept september sep شتنبر septiembre",
    10: "octobre october oct أكتوبر اكتوبر octubre",
    11: "novembre november nov نونبر noviembre",
    12: "décembre decembre déc december dec دجنبر diciembre dic",
}
# Names that mean UTC itself.
UTC_NAMES = ("z", "utc", "gmt", "ut")
# Arabic-Indic digits and their extended forms, as the patterns know ASCII digits only.
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2

_ZONE = r"(?:\s*(?:\[([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)*)\]|([A-Za-z_]+/[A-Za-z0-9_+\-/]+|Z|UTC|GMT|UT)|([+-]\d{2}:?\d{2})))?"
_CLOCK = r"(\d{1,2})(?:\s*[:.hH]\s*(\d{2}))(?:[:.](\d{2}))?(?:[.,]\d+)?\s*([AaPp]\.?[Mm]\.?)?"
_GAP = r"(?:\s*(?:,|-|–|T|à|at|le)?\s*)"
_WEEKDAY = r"(?:\p{L}+\.?,?\s+)?"

#: name, pattern, positions of year, month, day, hour, minute, second, am/pm, zone groups
_PATTERNS = [
    ("dmy", rf"^{_WEEKDAY}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:{_GAP}{_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, (8, 9, 10))),
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:{_GAP}{_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, (8, 9, 10))),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 0, (7, 8, 9))),
    ("named", rf"^{_WEEKDAY}(\d{{1,2}})(?:er|ère|e|st|nd|rd|th)?[\s\-]+(?:de\s+)?(\p{{L}}+)\.?,?[\s\-]+(?:de\s+)?(\d{{4}}|\d{{2}})(?:{_GAP}{_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, (8, 9, 10))),
    ("mdy", rf"^(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:{_GAP}{_CLOCK}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, (8, 9, 10))),
]
_COUNT = r"^-?\d{9,11}(?:\.\d+)?$"
_COUNT_MS = r"^-?\d{12,14}(?:\.\d+)?$"
_COUNT_US = r"^-?\d{15,17}$"

#: No zone changes before FIRST_YEAR + 1; the 28 years to LAST_YEAR hold every calendar a year can have and only changes by rule.
FIRST_YEAR, LAST_YEAR = 1800, 2128


@dataclass(frozen=True)
class Field:
    """A column of timestamps: its house form and the zone of values that name none."""

    name: str
    house: str
    zone: str


OFFER_FIELDS = (
    Field("date_publication", r"^\d{2}/\d{2}/\d{4}$", "Africa/Casablanca"),
    Field("date_limite", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$", "Africa/Casablanca"),
    Field("first_seen_at", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "UTC"),
)


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for number, names in MONTHS.items() for word in names.split() for x in (word, number)]
    return F.element_at(F.create_map(*pairs), F.lower(name))


#: What stands between captured fields; values that hold one themselves are of no known form.
_MARK = "\x1f"


def _captured(cells: Column) -> Column:
    """Fields of the first pattern that fits each text of an array, joined in one order by ``_MARK``.

    Each pattern is one replacement, tried on texts that no earlier one has taken apart; texts
    that fit none stay as they are. Groups that took no part come out empty.
    """
    for _, pattern, (gy, gm, gd, gh, gi, gs, ga, zones) in _PATTERNS:
        order = (gy, gm, gd, gh, gi, gs, ga, *zones)
        fields = _MARK.join(f"${g}" if g else "" for g in order)
        cells = F.transform(cells, lambda t: F.when(t.contains(_MARK), t).otherwise(F.regexp_replace(t, pattern, fields)))  # noqa: B023
    return cells


def _local_struct(fields: Column, default_zone: Column) -> Column:
    """struct(local: seconds of the local clock, zone, offset) from the captured fields."""
    part = [fields[i] for i in range(10)]
    number = [p.try_cast("int") for p in part]
    year = F.when(F.length(part[0]) == 2, number[0] + 2000).otherwise(number[0])
    month = F.coalesce(number[1], _month_number(part[1]))
    hour, half = F.coalesce(number[3], F.lit(0)), F.upper(F.substring(part[6], 1, 1))
    hour = (
        F.when(half == "", hour)
        .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
        .otherwise(hour % 12 + F.when(half == "P", 12).otherwise(0))
    )
    local = F.unix_seconds(
        F.try_make_timestamp(
            year,
            month,
            number[2],
            hour,
            F.coalesce(number[4], F.lit(0)),
            F.coalesce(number[5], F.lit(0)).cast("decimal(8,6)"),
            F.lit("UTC"),
        )
    )
    zone, shift = F.concat(part[7], part[8]), F.regexp_replace(part[9], ":", "")
    seconds = F.substring(shift, 2, 2).try_cast("int") * 3600 + F.substring(shift, 4, 2).try_cast("int") * 60
    offset = (
        F.when((zone == "") & (shift == ""), F.lit(None).cast("int"))
        .when(F.lower(zone).isin(*UTC_NAMES), F.lit(0))
        .when(zone == "", F.when(F.substring(shift, 1, 1) == "-", -seconds).otherwise(seconds))
    )
    return F.struct(
        local.alias("local"),
        F.when(offset.isNull(), F.when(zone != "", zone).otherwise(default_zone)).alias("zone"),
        offset.cast("long").alias("offset"),
    )


def _counted(text: Column) -> Column:
    """The same struct for a bare count of seconds, milli- or microseconds from 1970; else null."""
    unit = (
        F.when(text.rlike(_COUNT), F.lit(1)).when(text.rlike(_COUNT_MS), F.lit(1000)).when(text.rlike(_COUNT_US), F.lit(1_000_000))
    )
    seconds = F.floor(text.try_cast("decimal(28,6)") / unit).cast("long")
    return F.when(
        unit.isNotNull(),
        F.struct(seconds.alias("local"), F.lit(None).cast("string").alias("zone"), F.lit(0).cast("long").alias("offset")),
    )


@lru_cache(maxsize=None)
def zone_segments(zone: str, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> tuple[tuple[int, int, int, int], ...]:
    """Disjoint local-time segments ``(lo, hi, matches, offset)`` of a zone's offset history.

    ``offset`` is the one to subtract: of two matching intervals the earlier instant's, of
    none the one in force before the gap.
    """
    info = ZoneInfo(zone)
    utc = dt.timezone.utc

    def at(second: int) -> int:
        return int(dt.datetime.fromtimestamp(second, utc).astimezone(info).utcoffset().total_seconds())

    start = int(dt.datetime(first_year, 1, 1, tzinfo=utc).timestamp())
    end = int(dt.datetime(last_year + 1, 1, 1, tzinfo=utc).timestamp())
    intervals, begun, offset = [], start, at(start)
    step = 7 * 86400
    for probe in range(start + step, end + step, step):
        # several changes may lie within a step only if they undo each other; a week is less than any rule has
        while at(probe) != offset:
            lo, hi = max(probe - step, begun), probe
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if at(mid) != offset else (mid, hi)
            intervals.append((begun, hi, offset))
            begun, offset = hi, at(hi)
    intervals.append((begun, end + step, offset))
    edges = sorted({b + o for b, _, o in intervals} | {e + o for _, e, o in intervals})
    out = []
    for lo, hi in zip(edges, edges[1:]):
        hits = [o for b, e, o in intervals if b + o <= lo and hi <= e + o]
        before = [o for b, e, o in intervals if e + o <= lo]
        out.append((lo, hi, len(hits), max(hits) if hits else before[-1]))
    return tuple(out)


def covered_local(local: Column) -> Column:
    """A local time of the years covered by segments that meets the same offsets."""
    year = F.year(F.timestamp_seconds(local))
    kind = lambda y: (dt.date(y, 1, 1).weekday(), dt.date(y, 12, 31).timetuple().tm_yday)
    like = {kind(y): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    same = F.lit([like[kind(LAST_YEAR + 1 + k)] for k in range(400)])  # calendars repeat after 400 years
    start = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("long") * 86400
    later = local - start(year) + start(F.get(same, (year - LAST_YEAR - 1) % 400))
    early = int(dt.datetime(FIRST_YEAR, 7, 1, tzinfo=dt.timezone.utc).timestamp())
    return F.when(year <= FIRST_YEAR, F.lit(early).cast("long")).when(year > LAST_YEAR, later).otherwise(local)


def segments_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """The segments of ``zones`` exploded by local year.

    Bounded by the list of IANA zones times the years covered, whatever the input size.
    """
    rows = []
    for zone in zones:
        for lo, hi, matches, offset in zone_segments(zone):
            first = dt.datetime.fromtimestamp(lo, dt.timezone.utc).year
            last = dt.datetime.fromtimestamp(hi - 1, dt.timezone.utc).year
            rows += [(zone, year, lo, hi, matches, offset) for year in range(first, last + 1)]
    return spark.createDataFrame(rows, "_z_zone string, _z_year int, _z_lo long, _z_hi long, _z_matches int, _z_offset long")


def zones_named(df: DataFrame, text: str, default_zone: str) -> list[str]:
    """The IANA zones that values or defaults name: no more than there are, since others are dropped.

    Values are searched for a name only, not parsed.
    """
    written_out = F.when(F.col(text).rlike(r"\p{L}/\p{L}"), F.regexp_extract(text, r"([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)", 1))
    bare = F.when(F.col(text).contains("["), F.regexp_extract(text, r"\[([A-Za-z_]+)\]", 1))
    names = df.select(F.explode(F.array(F.col(default_zone), written_out, bare)).alias("zone")).where(F.col("zone").isin(*sorted(available_timezones())))
    return sorted(r.zone for r in names.distinct().collect())


def to_instants(df: DataFrame, text: str, default_zone: str) -> DataFrame:
    """Adds ``utc`` (timestamp or null if unreadable) and ``clock`` to the rows of ``df``.

    ``clock`` is ``repeated`` or ``skipped`` where the local time met two intervals or none,
    else ``once``; null where the value is unreadable. ``default_zone`` names a column.
    """
    spark = df.sparkSession
    plain = F.translate(F.col(text), ARABIC_DIGITS + _MARK, ASCII_DIGITS + "?")
    clean = F.trim(F.regexp_replace(plain, r"[\s\u00a0\u202f]+", " "))
    # bound in lambdas and behind a generator, each step is computed once and not copied into filters
    read = F.transform(
        _captured(F.array(clean)),
        lambda x: F.when(x.contains(_MARK), _local_struct(F.split(x, _MARK, -1), F.col(default_zone))).otherwise(_counted(x)),
    )
    parsed = df.withColumn("_p", F.explode(read))
    segments = segments_table(spark, zones_named(df, text, default_zone))
    local, near = F.col("_p.local"), F.col("_near")
    joined = parsed.withColumn("_near", covered_local(local)).withColumn("_year", F.year(F.timestamp_seconds(near))).join(
        F.broadcast(segments),
        (F.col("_p.zone") == F.col("_z_zone")) & (F.col("_year") == F.col("_z_year")) & (near >= F.col("_z_lo")) & (near < F.col("_z_hi")),
        "left",
    )
    offset = F.coalesce(F.col("_p.offset"), F.col("_z_offset"))
    clock = (
        F.when(F.col("_p.offset").isNotNull(), F.lit("once"))
        .when(F.col("_z_matches") == 1, F.lit("once"))
        .when(F.col("_z_matches") >= 2, F.lit("repeated"))
        .when(F.col("_z_matches") == 0, F.lit("skipped"))
    )
    return joined.withColumn("utc", F.timestamp_seconds(local - offset)).withColumn(
        "clock", F.when(F.col("utc").isNotNull(), clock)
    ).drop("_p", "_near", "_year", "_z_zone", "_z_year", "_z_lo", "_z_hi", "_z_matches", "_z_offset")


def normalised_fields(offers: DataFrame, fields: tuple[Field, ...] = OFFER_FIELDS) -> DataFrame:
    """(offer_row, field, value, utc, clock, house) for every value that is neither null nor empty."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("field"),
                F.col(f.name).alias("value"),
                F.lit(f.zone).alias("default_zone"),
                F.coalesce(F.col(f.name).rlike(f.house), F.lit(False)).alias("shaped"),
            )
            for f in fields
        ]
    )
    rows = (
        offers.select("offer_row", F.explode(pairs).alias("_v"))
        .select("offer_row", "_v.*")
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
    )
    done = to_instants(rows, "value", "default_zone")
    return done.select(
        "offer_row", "field", "value", "utc", "clock", (F.col("shaped") & F.col("utc").isNotNull()).alias("house")
    )


def instant_text(utc: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` in UTC, or ``unreadable``."""
    shown = F.date_format(F.to_utc_timestamp(utc, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(shown, F.lit("unreadable"))


def timestamp_cases(offers: DataFrame) -> DataFrame:
    """(offer_row, field, utc) of the values not in house form or with a doubtful Moroccan clock time."""
    wall = F.col("field").isin("date_publication", "date_limite") & F.col("clock").isin("repeated", "skipped")
    return (
        normalised_fields(offers)
        .where(~F.col("house") | wall)
        .select("offer_row", "field", instant_text(F.col("utc")).alias("utc"))
        .distinct()
    )
