"""Column repairs before a table is shown for review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import CLASSES, NEUTRAL_REASON, WARM

# Plain decimal numbers only. Spark's own cast also takes "50d" or "1f", which are not numbers
# in a spreadsheet.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Scores are 64-bit whole numbers; this is the first number beyond them.
LONG_LIMIT = float(1 << 63)


def parse_number(col: Column, numeric: bool = False) -> Column:
    """A column as double; text that is no number, NaN and infinities become NULL.

    ``numeric`` says that the column holds numbers already, which saves matching text.
    """
    if not numeric:
        col = F.regexp_substr(col.cast("string"), F.lit(NUMBER_PATTERN))
    number = col.try_cast("double")
    # NaN is above every number, infinity included.
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def coerce_score(col: Column, default: int = 10, numeric: bool = False) -> Column:
    """Score as bigint, cut toward zero; missing, unreadable or beyond 64 bits gives ``default``."""
    number = parse_number(col, numeric)
    return F.when(F.abs(number) < LONG_LIMIT, number.cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def coerce_class(col: Column, default: str = WARM) -> Column:
    """One of the three classes, compared case-sensitively; anything else gives ``default``."""
    return F.when(col.isin(*CLASSES), col).otherwise(F.lit(default))


def fill_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def fill_reason(col: Column, default: str = NEUTRAL_REASON) -> Column:
    return F.coalesce(col.cast("string"), F.lit(default))
