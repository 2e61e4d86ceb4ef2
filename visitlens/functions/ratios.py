"""Ratios with two decimals, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_half_up(part: str, whole: str) -> Column:
    """Column ``part`` / column ``whole`` with two decimals, half up; NULL when whole is 0.

    The rounding is done on the exact rational in 64-bit integers: a double such as
    29/200 is not exact, so rounding it would depend on its binary error.
    """
    return F.expr(f"(({part} * 200 + {whole}) div nullif({whole} * 2, 0)) / 100D")
