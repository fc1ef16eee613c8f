"""Time arithmetic on TIMESTAMP_NTZ columns, independent of the session zone.

Every job takes an explicit ``as_of`` instead of the wall clock.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROSECOND = "INTERVAL 1 MICROSECOND"


def instant(value: str | datetime | Column) -> Column:
    """``value`` as a TIMESTAMP_NTZ column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def day(value: str | date | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)[:10]).cast("date")


def end_of_day(value: str | date | Column) -> Column:
    """23:59:59.999999 of the day."""
    return F.date_add(day(value), 1).cast("timestamp_ntz") - F.expr(MICROSECOND)


def shift(ts: Column, **span: int) -> Column:
    """``ts`` moved by days / hours / mins / secs."""
    parts = {name: F.lit(amount) for name, amount in span.items()}
    return ts + F.make_dt_interval(**parts)


def age_days(ts: Column, now: Column) -> Column:
    """Whole elapsed days, floored, so negative for future instants (Q2)."""
    whole = F.datediff(now, ts)
    return whole - F.when(ts + F.make_dt_interval(days=whole) > now, 1).otherwise(0)


def closes_day(ts: Column) -> Column:
    """1 when ``ts`` is the last microsecond of its day. Such an instant is the
    one extra point of the closed rollup windows (Q1)."""
    return F.when(F.to_date(ts + F.expr(MICROSECOND)) > F.to_date(ts), 1).otherwise(0)


def linear_decay(age: Column, horizon: float) -> Column:
    """1 at age 0, 0 from ``horizon`` on; above 1 for future instants (Q3); null
    without an age (``greatest`` alone would skip the null)."""
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), 1.0 - age / F.lit(float(horizon))))


# Formats other than ISO 8601 that `parse_instant` accepts, in this order (H5).
# Fixed values.
ZONED_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "dd-MMM-yyyy", "d MMMM yyyy", "yyyyMMdd")
ENDS_WITH_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"
# The common form of feeds, the first of the zoned formats, read by its places from the end.
PLAIN_ZONED = r"^\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [1-9]\d{3} (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d [+-](?:0\d|1[0-7])[0-5]\d\z"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _plain_zoned(text: Column) -> Column:
    """A text of the form `PLAIN_ZONED` to naive UTC; null for a day the month has not."""
    digits = lambda first, n: F.substring(text, first, n).cast("int")
    month = F.floor((F.instr(F.lit(MONTHS), F.substring(text, -23, 3)) + 2) / 3).cast("int")
    local = F.try_make_timestamp_ntz(
        digits(-19, 4), month, F.substring_index(text, " ", 1).cast("int"), digits(-14, 2), digits(-11, 2), digits(-8, 2).cast("decimal(16,6)")
    )
    ahead = F.make_dt_interval(hours=digits(-4, 2), mins=digits(-2, 2))
    return F.when(F.substring(text, -5, 1) == "-", local + ahead).otherwise(local - ahead)


def parse_instant(text: Column) -> Column:
    """Text to naive UTC; null when no format fits. Zoned texts are converted to
    UTC, zoneless ones are taken as UTC (Q23)."""

    def to_utc(zoned: Column) -> Column:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))

    def read(cleaned: Column) -> Column:
        iso = F.when(cleaned.rlike(ENDS_WITH_ZONE), to_utc(cleaned.try_cast("timestamp"))).otherwise(
            cleaned.try_cast("timestamp_ntz")
        )
        is_iso = cleaned.rlike(r"^\d{4}-\d{2}-\d{2}")
        zoned = [to_utc(F.try_to_timestamp(cleaned, F.lit(f))) for f in ZONED_FORMATS]
        plain = [F.try_to_timestamp(cleaned, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
        return F.when(is_iso, iso).when(cleaned.rlike(PLAIN_ZONED), _plain_zoned(cleaned)).otherwise(F.coalesce(*zoned, *plain))

    # Java's formatter reads the weekday strictly; it carries no information. ``text`` may be
    # a costly expression: in the lambda it is a value.
    cleaned = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s+", "")
    return F.get(F.transform(F.array(cleaned), read), 0)


def epoch_instant(seconds: Column) -> Column:
    """Unix seconds to naive UTC."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.try_cast("decimal(18,6)"))
