"""Lenient parsing as column expressions: a value and the code of how it parsed.

Nothing here raises. Times are wall-clock (``timestamp_ntz``) in the zone of the
configuration: all comparisons of the pipeline are made on the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FLAG, FLAG_CODES

NTZ = "timestamp_ntz"

#: Raw status in lower case -> status.
STATUSES = {
    "scheduled": "scheduled", "confirmed": "confirmed", "tentative": "tentative",
    "completed": "completed", "cancelled": "cancelled", "canceled": "cancelled",
}


#: The white space that is taken off around a value, which is all that Unicode knows.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(raw: Column) -> Column:
    return F.btrim(raw, F.lit(SPACE))


def clean(raw: Column) -> Column:
    """Without white space around it; null if nothing is left."""
    return F.nullif(trimmed(raw), F.lit(""))


# --- ISO 8601 ---------------------------------------------------------------------
#
# Dates are calendar dates or weeks, with dashes or without; any one character
# parts date and time; times have colons or none and end at any component, which
# may have a fraction, of which six digits count; offsets are times with a sign.
# Most values have one of a few shapes and are read by position (``_PLAIN``);
# patterns are matched only against the others.

_DATE = r"(?:(\d{4})-(\d\d)-(\d\d)|(\d{4})(\d\d)(\d\d)|(\d{4})-W(\d\d)(?:-(\d)(?!\d))?|(\d{4})W(\d\d)(\d)?)"
#: Year, month, day, week, day of the week.
_DATE_PARTS = "$1$4$7$10,$2$5,$3$6,$8$11,$9$12"
_TIME = r"(\d\d)(?::(\d\d)(?::(\d\d)(?:[.,:](\d+))?|[.,](\d+))?|(\d\d)(?:(\d\d)(?:[.,]?(\d+))?|[.,](\d+))?|[.,](\d+))?"
#: One stray character before an offset is passed over, but not behind a fraction.
_CLOCK = rf"^{_TIME}(?:(?:(?<![.,]\d{{1,20}}).)?([+-]){_TIME})?$"
#: Hour, minute, second, fraction; sign; the same four of the offset.
_CLOCK_PARTS = "$1,$2$6,$3$7,$4$5$8$9$10,$11,$12,$13$17,$14$18,$15$16$19$20$21"
#: Single digits, which ISO does not know: read, but malformed.
_LOOSE = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T|\s+)(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
#: Shapes with every digit as 0: without a zone, without seconds, and with a zone from the 20th character on.
_NAIVE, _CUT = "0000-00-00T00:00:00", "0000-00-00T00:00"
_PLAIN = (_NAIVE, _CUT, *[_NAIVE + zone for zone in ("Z", "+00:00", "-00:00")])


def _shape(text: Column) -> Column:
    return F.translate(text, "123456789", "000000000")


def _number(part: Column) -> Column:
    """The number that ``part`` says, 0 if it is empty or missing."""
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("0")).cast("int")


def _matched(text: Column, pattern: str, parts: str, n: int) -> Column:
    """The parts of a text as an array of ``n`` strings, null where it does not match."""
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, parts), ",", n))


def _day(parts: Column) -> Column:
    """The date of :data:`_DATE_PARTS`; null if there is none such."""
    year, week, weekday = parts[0], _number(parts[3]), F.when(parts[4] == "", 1).otherwise(_number(parts[4]))
    plain = F.concat_ws("-", year, parts[1], parts[2]).try_cast("date")
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")  # always in the first week; the year's last is that of December 28
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    of_week = F.when(week.between(1, last) & weekday.between(1, 7), F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + weekday - 1))
    return F.when(year != "0000", F.when(parts[3] == "", plain).otherwise(of_week))


def with_date(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Add ``name``, the date in ``raw``, and ``<name>_code``: ISO dates and weeks, then month-first shapes, which are flagged.

    As all that adds columns here it takes steps, so that no part is computed twice.
    """
    text, plain, parts, iso, other = (F.col(f"_{name}_{x}") for x in ("text", "plain", "parts", "iso", "other"))
    df = df.withColumn(f"_{name}_text", trimmed(F.col(raw)))
    df = df.withColumn(f"_{name}_plain", F.coalesce(_shape(text) == "0000-00-00", F.lit(False)))
    df = df.withColumn(f"_{name}_parts", F.when(~plain, _matched(text, f"^{_DATE}$", _DATE_PARTS, 5)))
    df = df.withColumn(f"_{name}_iso", F.when(plain, F.when(~text.startswith("0000"), text.try_cast("date"))).when(parts.isNotNull(), _day(parts)))
    tried = lambda shape, pattern: F.when(text.rlike(shape), F.try_to_date(text, pattern))
    late = F.coalesce(tried(r"^\d{1,2}-\d{1,2}/\d{4}$", "M-d/yyyy"), tried(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))
    df = df.withColumn(f"_{name}_other", F.when(iso.isNull(), late))
    code = F.when(iso.isNotNull(), F.lit(None)).when(other.isNotNull(), "MALFORMED_DATE").otherwise("UNPARSABLE_DATE")
    return df.withColumns({name: F.coalesce(iso, other), f"{name}_code": code}).drop(text, plain, parts, iso, other)


def with_time(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Add ``name``, the seconds of the day of ``H:M`` or ``H:M:S`` in ``raw``, and ``<name>_code``."""
    parts, kept = F.col(f"_{name}_parts"), F.col(f"_{name}_kept")
    text = trimmed(F.col(raw))
    df = df.withColumn(f"_{name}_parts", F.when(text.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"), F.transform(F.split(text, ":"), lambda p: p.cast("int"))))
    second = F.coalesce(F.get(parts, F.lit(2)), F.lit(0))
    df = df.withColumn(f"_{name}_kept", F.when((parts[0] < 24) & (parts[1] < 60) & (second < 60), parts[0] * 3600 + parts[1] * 60 + second))
    return df.withColumns({name: kept, f"{name}_code": F.when(kept.isNull(), "TIME_MISSING")}).drop(parts, kept)


def combine(day: Column, seconds: Column) -> Column:
    """The wall-clock time of a date and seconds of the day; null if either is."""
    return F.try_make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("decimal(16,6)")
    )


def _clock(parts: Column, first: int) -> tuple[Column, Column, Column, Column]:
    """Hour, minute, second, microsecond from four parts."""
    hour, minute, second = (_number(parts[first + k]) for k in range(3))
    return hour, minute, second, _number(F.substring(F.rpad(parts[first + 3], 6, "0"), 1, 6))


def with_timestamp(df: DataFrame, raw: str, name: str, zone: str) -> DataFrame:
    """Add ``name``, the wall-clock time of the ISO text in ``raw``, and ``<name>_code``.

    An offset is converted, none is assumed to be local. A missing second makes
    it malformed, which wins over the assumed zone. Only the part after the last
    ``T`` is looked at for that, up to a plus or a Z. Single digits are read and
    malformed. It takes steps of columns, so that no part is computed twice.
    """
    text, shape, plain, zoned, date, clock, loose, wall, shift, cut = (F.col(f"_{name}_{x}") for x in ("text", "shape", "plain", "zoned", "date", "clock", "loose", "wall", "shift", "cut"))
    none = F.lit(None).cast("array<string>")
    df = df.withColumn(f"_{name}_text", trimmed(F.col(raw)))
    df = df.withColumn(f"_{name}_shape", _shape(text))
    df = df.withColumn(f"_{name}_plain", F.coalesce(shape.isin(*_PLAIN), F.lit(False)))
    df = df.withColumn(f"_{name}_zoned", F.when(~plain, F.replace(text, F.lit("Z"), F.lit("+00:00"))))
    df = df.withColumn(f"_{name}_date", _matched(zoned, f"^{_DATE}(?s:.(.+))?$", f"{_DATE_PARTS},$13", 6))
    df = df.withColumn(f"_{name}_clock", F.when(date[5] != "", _matched(date[5], _CLOCK, _CLOCK_PARTS, 9)))
    df = df.withColumn(f"_{name}_loose", F.when(~plain & (date.isNull() | ((date[5] != "") & clock.isNull())), _matched(text, _LOOSE, "$1-$2-$3,$4,$5,$6,", 5)).otherwise(none))

    hour, minute, second, micro = _clock(clock, 0)
    seconds = F.concat_ws(".", second.cast("string"), F.lpad(micro.cast("string"), 6, "0")).cast("decimal(18,6)")
    timed = F.when((hour < 24) & (minute < 60) & (second < 60), _day(date).cast(NTZ) + F.make_dt_interval(F.lit(0), hour, minute, seconds))
    own = F.when(~loose[0].startswith("0000") & (_number(loose[1]) < 24) & (_number(loose[2]) < 60) & (_number(loose[3]) < 60), loose[0].try_cast("date").cast(NTZ) + F.make_dt_interval(F.lit(0), _number(loose[1]), _number(loose[2]), _number(loose[3]).cast("decimal(18,6)")))
    by_place = F.when(~text.startswith("0000"), F.concat(F.substring(text, 1, 19), F.when(shape == _CUT, ":00").otherwise("")).try_cast(NTZ))
    hours, minutes = F.substring(text, 21, 2).cast("int"), F.substring(text, 24, 2).cast("int")
    sign = lambda c: F.when(c == "-", -1).otherwise(1)
    h, m, s, us = _clock(clock, 5)
    moved = (h * 3600 + m * 60 + s).cast("long") * 1_000_000 + us
    behind = F.regexp_replace(F.element_at(F.split(text, "T"), -1), r"[+Z].*$", "")
    df = df.withColumns({
        f"_{name}_wall": F.when(plain, by_place).when(clock.isNotNull(), timed).when(date.isNotNull() & (date[5] == ""), _day(date).cast(NTZ)).otherwise(own),
        # Microseconds; null without an offset, and a whole day where there is no such offset.
        f"_{name}_shift": F.when(shape.isin(_NAIVE, _CUT), F.lit(None)).when(plain & shape.endswith("Z"), F.lit(0)).when(plain, sign(F.substring(text, 20, 1)) * (hours * 3600 + minutes * 60).cast("long") * 1_000_000)
        .when(clock[4] != "", sign(clock[4]) * moved),
        f"_{name}_cut": F.when(plain, shape == _CUT).otherwise(loose.isNotNull() | (F.coalesce(text.contains("T"), F.lit(False)) & (F.length(behind) - F.length(F.replace(behind, F.lit(":"), F.lit(""))) == 1))),
    })
    away = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (shift / F.lit(1_000_000)).cast("decimal(18,6)"))
    local = F.when(F.abs(shift) < 86_400_000_000, F.convert_timezone(F.lit("UTC"), F.lit(zone), wall - away))
    df = df.withColumn(name, F.when(shift.isNull(), wall).otherwise(local))
    code = F.when(F.col(name).isNull() | cut, "MALFORMED_DATETIME").when(shift.isNull(), "TIMEZONE_ASSUMED")
    return df.withColumn(f"{name}_code", code).drop(text, shape, plain, zoned, date, clock, loose, wall, shift, cut)


def read_emails(raws: Column) -> Column:
    """Each raw value as (raw, email, key, code), in order.

    ``email`` is an address in lower case, with ``[at]`` and ``[dot]`` undone,
    and null for a label; ``key`` is the address, or else the label in lower case.
    """
    texts = F.transform(raws, lambda r: F.struct(r.alias("raw"), clean(r).alias("text")))
    fixed = F.transform(texts, lambda r: F.struct(r["raw"].alias("raw"), r["text"].alias("text"), F.replace(F.replace(r["text"], F.lit("[at]"), F.lit("@")), F.lit("[dot]"), F.lit(".")).alias("fixed")))
    mails = F.transform(fixed, lambda r: F.struct(r["raw"].alias("raw"), r["text"].alias("text"), (r["fixed"] != r["text"]).alias("mended"), F.when(F.contains(r["fixed"], F.lit("@")), F.lower(r["fixed"])).alias("email")))
    return F.transform(
        mails,
        lambda r: F.struct(
            r["raw"].alias("raw"), r["email"].alias("email"), F.coalesce(r["email"], F.lower(r["text"]), F.lit("")).alias("key"),
            F.when(r["email"].isNull(), "NON_EMAIL_ATTENDEE").when(r["mended"], "MALFORMED_EMAIL").alias("code"),
        ),
    )


def parse_status(raw: Column) -> tuple[Column, Column]:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv]), F.lower(clean(raw)))
    return F.coalesce(known, F.lit("unknown")), F.when(known.isNull(), "UNKNOWN_STATUS")


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.lower(F.substring_index(email, "@", -1)))


def flag(code: Column, field: str, raw: Column, *codes: str) -> Column:
    """A flag struct; null where ``code`` is null. ``codes`` are the values that it may have.

    Each gives a struct of its own with constant severity and message, so that
    no table is looked up row by row.
    """
    made = F.lit(None)
    for known in codes:
        severity, message = FLAG_CODES[known]
        one = F.struct(F.lit(known).alias("code"), F.lit(field).alias("field"), raw.cast("string").alias("raw_value"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
        made = F.when(code == known, one).otherwise(made)
    return made.cast(FLAG)
