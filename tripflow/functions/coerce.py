"""Lenient conversions: bad values become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JVM also accepts hexadecimal floats and a d/f suffix; neither is a number here.
_JVM_ONLY_NUMBER = r"(?i)x|[0-9.][df]$"


# The white space that surrounds a value without being part of it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def to_number(text: Column) -> Column:
    """Text to double; unparseable text and NaN become null."""
    trimmed = strip(text.cast("string"))
    number = trimmed.try_cast("double")
    return F.when(~trimmed.rlike(_JVM_ONLY_NUMBER) & ~F.isnan(number), number)


# The times that 64 bits of nanoseconds can hold, in microseconds.
FIRST_MICROS, LAST_MICROS = -9223372036854775, 9223372036854775


def to_utc(text: Column) -> Column:
    """ISO text, with or without an offset, to a timestamp (session zone UTC).

    Times before September 1677 or after April 2262 are null, so a calendar over
    any log has a bounded number of days.
    """
    at = F.try_to_timestamp(text.cast("string"))
    return F.when(F.unix_micros(at).between(FIRST_MICROS, LAST_MICROS), at)


def iso_seconds(ts: Column) -> Column:
    """``2024-01-01T05:06:07+00:00``, fractions of a second dropped."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def first_present(*texts: Column) -> Column:
    """First value that is not null, empty or the word null; ``0`` counts as present."""
    return F.coalesce(*[F.when(~t.isin("", "null"), t) for t in texts])


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, so 1.005 rounds down at two digits.

    ``F.round`` works on the shortest decimal text and would round 1.005 up. A
    scaled value lands on .5 only after the multiplication was itself rounded;
    the rounding error of that multiplication (Dekker's product) says on which
    side of the tie the exact value lies.
    """
    scale = float(10**digits)
    splitter = 134217729.0  # 2**27 + 1
    scaled = value * scale
    value_high = value * splitter - (value * splitter - value)
    value_low = value - value_high
    scale_high = scale * splitter - (scale * splitter - scale)
    scale_low = scale - scale_high
    error = (
        (value_high * scale_high - scaled) + value_high * scale_low + value_low * scale_high
    ) + value_low * scale_low
    whole = F.floor(scaled).cast("double")
    fraction = scaled - whole
    up = (fraction > 0.5) | (
        (fraction == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1)))
    )
    return F.when(up, whole + 1).otherwise(whole) / scale
