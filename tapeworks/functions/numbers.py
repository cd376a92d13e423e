"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(c: Column, digits: int) -> Column:
    """round() without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


#: White space of any kind in ASCII.
SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"


def stripped(c: Column) -> Column:
    """A text cell without the white space around it."""
    return F.btrim(c, F.lit(SPACE))


def blank(c: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return c.isNull() | (stripped(c) == "")


def number(c: Column) -> Column:
    """The number in a text cell, else null: digits with sign, point and exponent, or nan and inf, around white space."""
    t = stripped(c)
    return F.when(t.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"), t.try_cast("double"))


def utc_text(seconds: Column, millis: Column | None = None) -> Column:
    """YYYY-MM-DD HH:MM:SS(.mmm) in UTC, whatever the session's time zone is."""
    s = F.pmod(seconds, F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    out = F.concat(day, F.lit(" "), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return out if millis is None else F.concat(out, F.lit("."), F.lpad(millis.cast("int").cast("string"), 3, "0"))
