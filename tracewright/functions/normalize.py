"""Column expressions that bring identifiers, instants and vocabulary into one spelling. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null when nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def canonical_uuid(c: Column) -> Column:
    """A UUID in lower case 8-4-4-4-12 form, however it was written.

    Accepts blanks around it, braces, a ``urn:uuid:`` prefix, missing hyphens and capitals. Text that is no UUID is
    returned trimmed and in lower case, so it still compares with itself; null and blank give null.
    """
    low = F.lower(F.trim(c))
    bare = F.regexp_replace(low, r"^urn:uuid:|[{}\s-]", "")
    dashed = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed).when(low != "", low)


def instant_millis(c: Column) -> Column:
    """Milliseconds since 1970 of a time written as text.

    ISO 8601 with ``T`` or a blank, any fraction, ``Z`` or an offset with or without colon; without zone it is UTC, and
    a bare number counts milliseconds. Null, blank and unreadable text give null.
    """
    t = F.trim(c)
    colon = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(t.rlike(r"(?i)(z|\d{2}:?\d{2}(\.\d+)?[+-]\d{2}:?\d{2})$"), colon).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^-?\d{1,18}$"), t.try_cast("bigint")).otherwise(F.unix_millis(zoned.try_cast("timestamp")))


def state_name(c: Column) -> Column:
    """A state in capitals and trimmed; blank gives null."""
    return F.upper(blank_to_null(c))


def event_type_name(c: Column) -> Column:
    """An event type in capitals, trimmed, with blanks and hyphens as underscores; blank gives null."""
    return F.translate(F.upper(blank_to_null(c)), " -", "__")


def epoch_seconds(epoch: Column, stamp: Column) -> Column:
    """Seconds since 1970 from a number in seconds, milli-, micro- or nanoseconds, else from a timestamp.

    The unit is told by magnitude: no time in seconds before the year 5000 reaches 1e11. Null, NaN and infinite numbers
    give way to the timestamp; null if that is missing too.
    """
    a = F.abs(epoch)
    scaled = F.when(a < 1e11, epoch).when(a < 1e14, epoch / 1e3).when(a < 1e17, epoch / 1e6).otherwise(epoch / 1e9)
    usable = epoch.isNotNull() & ~F.isnan(epoch) & (a < float("inf"))
    return F.coalesce(F.when(usable, scaled), F.unix_micros(stamp.cast("timestamp")) / 1e6)


def cents(amount: Column) -> Column:
    """An amount in hundredths as bigint; missing, NaN and infinite amounts are 0."""
    usable = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    return F.when(usable, F.round(amount * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
