"""Time helpers.  All instants are UTC; the session time zone is set to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def as_column(as_of) -> Column:
    """Accept a Column, a datetime or a text as the moment of analysis."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, rounded down (also when negative)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY_MICROS)).cast("int")


def iso_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]+00:00``; the fraction only when it is not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(base, F.when(micros == 0, "").otherwise(F.date_format(ts, ".SSSSSS")), F.lit("+00:00"))
