"""The share of leads worth calling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def potential_rate(hot: Column, warm: Column, total: Column) -> Column:
    """(hot + warm) / total * 100 as double; 0 for an empty table."""
    return F.coalesce(F.try_divide((hot + warm).cast("double"), total) * 100, F.lit(0.0))


def format_rate(rate: Column) -> Column:
    """Rate with one decimal, halves rounded to even."""
    return F.format_string("%.1f", F.bround(rate, 1))
