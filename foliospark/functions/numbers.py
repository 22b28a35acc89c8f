"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    """A double to so many places, halves away from zero, judged on its binary value times 10^places, as in SQL.

    F.round judges its shortest decimal text: 3/20000, just below 0.00015, goes to 0.0002 there and to 0.0001 here.
    """
    scale = F.lit(10.0**places)
    return F.round(c * scale) / scale
