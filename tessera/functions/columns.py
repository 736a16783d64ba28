"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def page_name(name: Column) -> Column:
    """A page name as compared: percent escapes decoded, blanks and tabs stripped.

    Escapes that are not two hex digits stay as they are; ``+`` stays ``+``.
    """
    safe = F.regexp_replace(F.replace(name, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(name.contains("%"), F.coalesce(F.try_url_decode(safe), name)).otherwise(name)
    return F.trim(decoded, F.lit(" \t"))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def stripped(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\r\n"))


def number(value: Column) -> Column:
    """A finite decimal number written in text, else null (never an ANSI error)."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def month_number(ts: Column) -> Column:
    """Months since year 0, an integer that orders and subtracts."""
    return F.year(ts) * 12 + F.month(ts) - 1


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
