"""Coercion, rounding and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank import vocab as V


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_dp(value: Column | str, digits: int) -> Column:
    """Round the decimal text of a double half up, as a double."""
    return F.round(col(value).cast("decimal(28,9)"), digits).cast("double")


def number_text(value: Column | str) -> Column:
    """Plain decimal text of a double: 0.7, 12.0, 0.000123 (never 1.23E-4)."""
    x = col(value).cast("double")
    tiny = F.regexp_replace(F.format_string("%.9f", x), "0+$", "")
    return F.when((F.abs(x) < 1e-3) & (x != 0), tiny).otherwise(x.cast("string"))


def is_true(value: Column | str) -> Column:
    """True for true, 1 and any-case "true"; false for everything else."""
    return F.coalesce(F.lower(col(value).cast("string")).isin("true", "1"), F.lit(False))


def is_false(value: Column | str) -> Column:
    return F.coalesce(F.lower(col(value).cast("string")).isin("false", "0"), F.lit(False))


def to_number(value: Column | str) -> Column:
    """Double, or NULL when NULL, blank, unparseable or not finite."""
    x = F.nullif(F.trim(col(value).cast("string")), F.lit("")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def bounded_preference(value: Column | str, low: float, high: float) -> Column:
    """1 inside [low, high], falling linearly to 0 outside."""
    x = col(value).cast("double")
    below = F.greatest(F.lit(0.0), x / low)
    above = F.greatest(F.lit(0.0), 1 - (x - high) / high)
    return F.when(x < low, below).when(x > high, above).when(x.isNotNull(), F.lit(1.0))


def signed_text(value: Column | str) -> Column:
    """``+0.123`` with three decimals, or the placeholder."""
    x = to_number(value)
    text = F.format_string("%.3f", round_dp(x, 3))
    return (
        F.when(x.isNull(), V.NOT_AVAILABLE)
        .when(x > 0, F.concat(F.lit("+"), text))
        .otherwise(text)
    )


def utc_seconds() -> Column:
    """Current time without a fraction, as a timestamp."""
    return F.date_trunc("second", F.current_timestamp())


def iso_text(ts: Column | str) -> Column:
    """ISO text in UTC with the offset, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(col(ts), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
