"""Text and time scalars shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_OFFSET = r"([zZ]|[+-]\d{2}(:?\d{2})?)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value), value being computed once however often f uses it: Spark shares no subexpressions across the branches of a CASE."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends; F.trim alone takes off spaces only."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def folded(c: Column | str) -> Column:
    """A key compared without regard to letter case and surrounding blanks."""
    return F.lower(strip(c))


def blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def instant(c: Column | str) -> Column:
    """ISO-8601 text as a timestamp; text without an offset is UTC whatever the session's zone.

    Takes 'T' or a blank between date and time, any number of fraction digits, 'Z', +hh, +hhmm and +hh:mm, and the
    compact form 20250131T101500Z. Null for blank or unreadable text.
    """
    t = strip(c)
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})[tT ](\d{2}):?(\d{2}):?(\d{2})", "$1-$2-$3T$4:$5:$6")
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[tT ]+", "$1T")
    t = F.regexp_replace(t, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    t = F.when(dated, F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    zoned = t.rlike(r"T.*" + ISO_OFFSET)
    full = F.when(zoned, F.upper(t)).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), full.try_cast("timestamp"))


def utc_month(c: Column | str) -> Column:
    """yyyy-MM of a timestamp in UTC, whatever the session's zone."""
    return F.date_format(F.date_from_unix_date(F.floor(F.unix_seconds(col(c)) / 86400).cast("int")), "yyyy-MM")


def utc_text(c: Column | str) -> Column:
    """A timestamp as yyyy-MM-ddTHH:mm:ss in UTC; one without a zone as it stands."""
    t = F.unix_seconds(col(c).cast("timestamp"))
    day = F.date_format(F.date_from_unix_date(F.floor(t / 86400).cast("int")), "yyyy-MM-dd")
    s = F.pmod(t, F.lit(86400))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
