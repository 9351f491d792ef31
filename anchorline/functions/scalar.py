"""Column expressions: time, age, clipping and strict text formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from anchorline.contracts import DATE_PATTERN, TIMESTAMP_PATTERN

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def micros(instant: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp or of a date's midnight, UTC."""
    column = F.col(instant) if isinstance(instant, str) else instant
    return F.unix_micros(column.cast("timestamp"))


def iso(instant: Column | str) -> Column:
    """An instant in the wire format, ``2024-01-31T08:00:00Z``."""
    column = F.col(instant) if isinstance(instant, str) else instant
    return F.date_format(column, TIMESTAMP_PATTERN)


def calendar_age(birth: Column | str, at: Column | str) -> Column:
    """Completed years at ``at``; a birthday counts on its own day."""
    birth = F.col(birth) if isinstance(birth, str) else birth
    at = F.col(at) if isinstance(at, str) else at
    month_day = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    before = (month_day(at) < month_day(birth)).cast("int")
    return (F.year(at) - F.year(birth) - before).cast("int")


def approximate_age(birth: Column | str, at: Column) -> Column:
    return F.datediff(at, birth) / F.lit(365.25)


def elapsed_days(start: Column | str, stop: Column | str) -> Column:
    """Days between two instants as a double."""
    return (micros(stop) - micros(start)) / F.lit(float(DAY))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` held inside ``[low, high]``; a missing one becomes ``high``."""
    bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNull(), F.lit(float(high))).otherwise(bounded)


# The exact shape of each text format. A text of this shape is read by a plain cast,
# which needs no formatter and raises nothing, and prints back as it was written.
SHAPES = {
    TIMESTAMP_PATTERN: r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$",
    DATE_PATTERN: r"^(?!0000)\d{4}-\d{2}-\d{2}$",
}


def parse_exact(value: Column | str, pattern: str) -> Column:
    """The instant of a text in exactly this format, NULL for any other text."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.rlike(SHAPES[pattern]), value.try_cast("timestamp"))


def parse_instant(value: Column | str) -> Column:
    return parse_exact(value, TIMESTAMP_PATTERN)


def parse_date(value: Column | str) -> Column:
    return parse_exact(value, DATE_PATTERN).cast("date")


def exact_format(value: Column, pattern: str) -> Column:
    """True when the text is a real instant or date in exactly this format."""
    return parse_exact(value, pattern).isNotNull()


def due_at(stop: Column | str, days: int) -> Column:
    stop = F.col(stop) if isinstance(stop, str) else stop
    return stop + F.make_dt_interval(F.lit(days))


def major_minor(version: Column) -> Column:
    """``major.minor`` of a three-part version, NULL when it is not one."""
    return F.when(version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.struct(
        F.element_at(F.split(version, r"\."), 1).try_cast("decimal(38,0)").alias("major"),
        F.element_at(F.split(version, r"\."), 2).try_cast("decimal(38,0)").alias("minor"),
    ))
