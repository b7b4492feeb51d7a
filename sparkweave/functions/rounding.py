"""Rounding that does not depend on an engine's treatment of halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(value: Column | str, digits: int = 6) -> Column:
    """Rounded to digits, after a nudge of a ten-thousandth of the last digit, so that sums in another order round alike."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(10.0 ** -(digits + 4)), digits)
