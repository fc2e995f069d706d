"""Date functions as column expressions; results are strings, as zones are part of the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)?$"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def offset_seconds(c: Column) -> Column:
    """Of an ISO date's zone: 0 for Z and none; null beyond 14 hours."""
    zone = F.regexp_extract(c, ISO, 8)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    seconds = sign * (F.regexp_extract(zone, r"^[+-](\d\d)", 1).try_cast("int") * 3600 + F.regexp_extract(zone, r"(\d\d)$", 1).try_cast("int") * 60)
    return F.when(zone.isin("", "Z"), F.lit(0)).when(F.abs(seconds) <= 14 * 3600, seconds)


def parse(c: Column) -> Column:
    """Struct of the instant in ms and the offset; null where it isn't an ISO date or the offset is too large."""
    part = lambda k: F.regexp_extract(c, ISO, k)
    local = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6))))
    ms = F.coalesce(F.floor(part(7).try_cast("double") * 1000 + 0.5), F.lit(0))
    offset = offset_seconds(c)
    return F.when(c.rlike(ISO) & offset.isNotNull(), F.struct(((local - offset) * 1000 + ms).alias("ms"), offset.alias("offset")))


def text(ms: Column) -> Column:
    """UTC; a fraction only if it isn't 0."""
    at = F.timestamp_millis(ms.cast("long"))
    return F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def local_date(ms: Column, offset: Column) -> Column:
    """Days since 1970 at that place."""
    return F.floor((F.floor(ms / 1000) + offset) / 86400)


def local_time(ms: Column, offset: Column) -> Column:
    """Seconds of the day at that place."""
    return F.pmod(F.floor(ms / 1000) + offset, F.lit(86400))


def guess(c: Column) -> Column:
    """ISO form of dates as files have them, by length; null if it isn't one.

    4: a year; 10: a date; 14: digits; 15: digits and Z; 19: a date and time with colons;
    21: digits and a quoted zone; 24: as the C library prints it; else ISO already.
    """
    s = lambda a, n: F.substring(c, a, n)
    digits = F.concat(s(1, 4), F.lit("-"), s(5, 2), F.lit("-"), s(7, 2), F.lit("T"), s(9, 2), F.lit(":"), s(11, 2), F.lit(":"), s(13, 2))
    names = F.create_map(*[F.lit(x) for k in range(12) for x in (MONTHS[3 * k : 3 * k + 3], f"{k + 1:02d}")])
    printed = F.concat(s(21, 4), F.lit("-"), F.element_at(names, s(5, 3)), F.lit("-"), F.lpad(F.trim(s(9, 2)), 2, "0"), F.lit("T"), s(12, 8))
    n = F.length(c)
    return (
        F.when(n < 4, None)
        .when((n == 4) & c.rlike(r"^\d{4}$") & (c != "0000"), F.concat(c, F.lit("-01-01T00:00:00Z")))
        .when(n == 4, None)
        .when((n == 10) & c.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(c, F.lit("T00:00:00")))
        .when(n == 10, None)
        .when((n == 14) & c.rlike(r"^\d{14}$"), digits)
        .when((n == 15) & c.rlike(r"^\d{14}Z$"), F.concat(digits, F.lit("Z")))
        .when((n == 21) & c.rlike(r"^\d{14}[+-]\d\d'\d\d'$"), F.concat(digits, s(15, 3), F.lit(":"), s(19, 2)))
        .when((n == 24) & c.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \d{4}$"), printed)
        .when((n == 19) & c.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$"), F.concat(s(1, 4), F.lit("-"), s(6, 2), F.lit("-"), s(9, 2), F.lit("T"), s(12, 8)))
        .when(c.rlike(ISO), c)
    )


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k in range(12) for x in (MONTHS[3 * k : 3 * k + 3], f"{k + 1:02d}")])
    return F.element_at(names, F.substring(name, 1, 3))


def page_description(c: Column) -> Column:
    """ISO form, with the zone as given or UTC, of the four forms of dates in page descriptions; null for others.

    (18:07 Tuesday 22 May 2007), Tue May 22 18:07:10 2007, 22 May 1997 18:07:10 -0600, 6:07 PM May 22, 2007
    """
    forms = (
        (r"^\((\d{1,2}):(\d\d) \w+ (\d{1,2}) (\w+) (\d{4})\)", {"h": 1, "mi": 2, "d": 3, "mo": 4, "y": 5}),
        (r"^[A-Za-z]+ (\w+) +(\d{1,2}) (\d\d):(\d\d):(\d\d) (\d{4})", {"mo": 1, "d": 2, "h": 3, "mi": 4, "s": 5, "y": 6}),
        (r"^(\d{1,2}) (\w+) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-]\d{4})", {"d": 1, "mo": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "z": 7}),
        (r"^(\d{1,2}):(\d\d) ([AP]M) (\w+) (\d{1,2}), (\d{4})", {"h": 1, "mi": 2, "pm": 3, "mo": 4, "d": 5, "y": 6}),
    )
    found = []
    for pattern, places in forms:
        part = lambda k, pattern=pattern, places=places: F.regexp_extract(c, pattern, places[k]) if k in places else None
        hour = part("h").try_cast("int")
        if "pm" in places:
            hour = hour % 12 + F.when(part("pm") == "PM", 12).otherwise(0)
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        clock = F.concat(two(hour), F.lit(":"), part("mi"), F.lit(":"), part("s") if "s" in places else F.lit("00"))
        found.append(F.when(c.rlike(pattern), F.concat(part("y"), F.lit("-"), _month(part("mo")), F.lit("-"), two(part("d")), F.lit("T"), clock, part("z") if "z" in places else F.lit("+0000"))))
    return F.coalesce(*found)


def remaining(elapsed: Column, done: Column, left: Column) -> Column:
    """Estimated seconds left, 0 if unknown."""
    return F.when((elapsed > 0) & (done > 0) & (left > 0), F.floor(elapsed / done * left)).otherwise(F.lit(0)).cast("long")


def completed(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, offset: Column) -> Column:
    """ISO form of a date known in part; null without a year.

    Missing parts are the least ones; hour, minute and zone only count
    together.  The zone is written in whole hours.
    """
    timed = hour.isNotNull() & minute.isNotNull()
    zone = F.when(timed, F.coalesce(offset, F.lit(0))).otherwise(F.lit(0))
    two = lambda c, least=0: F.lpad(F.coalesce(c.cast("int"), F.lit(least)).cast("string"), 2, "0")
    date = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month, 1), F.lit("-"), two(day, 1), F.lit("T"))
    clock = F.concat(two(F.when(timed, hour)), F.lit(":"), two(F.when(timed, minute)), F.lit(":"), two(second))
    return F.concat(date, clock, F.when(zone < 0, "-").otherwise("+"), two(F.abs(zone)), F.lit(":00"))


def formatted(c: Column, form: str, zone: str = "UTC") -> Column:
    """ISO form with the offset of ``zone`` at that time, of a text by a pattern without a zone; null if it doesn't fit."""
    local = F.try_to_timestamp(c, F.lit(form))
    minutes = (F.unix_seconds(local) - F.unix_seconds(F.to_utc_timestamp(local, zone))) / 60
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"), two(F.abs(minutes) / 60), two(F.abs(minutes) % 60))


def rfc1123(c: Column) -> Column:
    """ISO form of ``Tue, 22 May 2007 18:07:10 GMT`` or with a numeric zone; null for others."""
    form = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d) (GMT|[+-]\d{4})$"
    part = lambda k: F.regexp_extract(c, form, k)
    zone = F.when(part(5) == "GMT", "+0000").otherwise(part(5))
    return F.when(c.rlike(form), F.concat(part(3), F.lit("-"), _month(part(2)), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), zone))
