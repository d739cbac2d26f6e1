"""Clock handling. Every instant is UTC epoch milliseconds; ``as_of`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import strip

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
# Zone names that mail dates use, as offsets.
_ZONES = (("(?i)\\s(?:GMT|UTC|UT|Z)$", " +0000"), ("(?i)\\sEST$", " -0500"), ("(?i)\\sEDT$", " -0400"),
          ("(?i)\\sCST$", " -0600"), ("(?i)\\sCDT$", " -0500"), ("(?i)\\sMST$", " -0700"),
          ("(?i)\\sMDT$", " -0600"), ("(?i)\\sPST$", " -0800"), ("(?i)\\sPDT$", " -0700"))


def ntz_to_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less UTC timestamp, rounded down, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts)
    return days * DAY_MS + minutes * 60_000 + F.floor(seconds * 1000).cast("long")


def parse_pub_date(text: Column) -> Column:
    """Milliseconds of a mail-style or ISO date; zone-less means UTC; null when unreadable."""
    mail = F.regexp_replace(strip(text), r"^[A-Za-z]{3,9},\s*", "")
    for pattern, offset in _ZONES:
        mail = F.regexp_replace(mail, pattern, offset)
    with_zone = F.when(mail.rlike(r"[+-]\d{4}$"), mail).otherwise(F.concat(mail, F.lit(" +0000")))
    with_seconds = F.regexp_replace(with_zone, r"^(.*\s\d{1,2}:\d{2})(\s[+-]\d{4})$", "$1:00$2")
    iso = F.regexp_replace(strip(text), "Z$", "+00:00")
    iso_zoned = F.when(iso.rlike(r"[+-]\d{2}:\d{2}$"), iso).otherwise(
        F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(iso, F.lit("T00:00:00+00:00")))
        .otherwise(F.concat(iso, F.lit("+00:00")))
    )
    is_mail = mail.rlike(r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}")
    is_iso = iso.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.coalesce(
        F.unix_millis(F.when(is_mail, F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy H:m:s Z")))),
        F.unix_millis(F.when(is_iso, iso_zoned.try_cast("timestamp"))),
    )


def parse_seendate(text: Column) -> Column:
    """Milliseconds of ``yyyyMMddTHHmmssZ`` (also without ``Z``, or the bare day); null otherwise."""
    value = strip(text)
    digits = F.regexp_replace(value, "[TZ]", "")
    full = F.when(value.rlike(r"^\d{8}T\d{6}Z?$"), digits).when(
        value.rlike(r"^\d{8}$"), F.concat(digits, F.lit("000000"))
    )
    stamp = F.regexp_replace(
        full, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6+00:00"
    )
    return F.unix_millis(stamp.try_cast("timestamp"))


def seendate(ms: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` of an instant."""
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd'T'HHmmss'Z'")


def day_bucket(ms: Column) -> Column:
    return F.floor(ms / F.lit(DAY_MS)).cast("long")


def age_hours(as_of_ms: int, since_ms: Column) -> Column:
    """Hours since an instant, never negative; a missing instant counts as now."""
    since = F.coalesce(since_ms, F.lit(as_of_ms))
    return F.greatest(F.lit(0.0), (F.lit(as_of_ms) - since) / F.lit(float(HOUR_MS)))


def within(ms: Column, as_of_ms: int, span_ms: int) -> Column:
    """Inclusive at both ends; the future is outside."""
    return ms.between(as_of_ms - span_ms, as_of_ms)


def age_label(as_of_ms: int, ms: Column) -> Column:
    minutes = F.greatest(F.lit(0), F.floor((F.lit(as_of_ms) - ms) / F.lit(60_000)))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )
