"""Dashboard numbers over the joined table, taken before any repair.

Each function reads a ``_copies`` column where there is one, so the compact join result gives the
numbers of the full one. Counts are ``decimal(38,0)``: pairs of leads and scores may be more than a
bigint holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import CLASS, CLASS_LABELS, COPIES, HOT, JUNK, SCORE, WARM
from siftline.functions.rating import potential_rate
from siftline.operators.enrich import WIDE


def _rows(final: DataFrame, where: Column | None = None) -> Column:
    if COPIES not in final.columns:
        counted = F.count(F.lit(1) if where is None else F.when(where, F.lit(1)))
        return counted.cast(WIDE)
    weight = F.col(COPIES).cast(WIDE)
    counted = weight if where is None else F.when(where, weight)
    return F.coalesce(F.sum(counted), F.lit(0)).cast(WIDE)


def tally(final: DataFrame) -> DataFrame:
    """Rows per score and class, in ``_copies``: all that the dashboard needs, in one pass."""
    return final.groupBy(SCORE, CLASS).agg(_rows(final).alias(COPIES))


def kpis(final: DataFrame) -> DataFrame:
    """One row: total, hot, warm, junk, potential_rate. Rows of no known class count in the
    total only."""
    label = F.col(CLASS)
    counts = final.agg(
        _rows(final).alias("total"),
        _rows(final, label == HOT).alias("hot"),
        _rows(final, label == WARM).alias("warm"),
        _rows(final, label == JUNK).alias("junk"),
    )
    rate = potential_rate(F.col("hot"), F.col("warm"), F.col("total"))
    return counts.withColumn("potential_rate", rate)


def class_counts(final: DataFrame) -> DataFrame:
    """Rows per classification as it stands, missing ones left out."""
    known = final.where(F.col(CLASS).isNotNull())
    return known.groupBy(CLASS).agg(_rows(known).alias("n"))


def class_distribution(kpi_row: DataFrame) -> DataFrame:
    """Three labelled rows from the one-row result of ``kpis``, zeros included."""
    columns = {HOT: "hot", WARM: "warm", JUNK: "junk"}
    rows = [
        F.struct(F.lit(CLASS_LABELS[c]).alias("label"), F.col(columns[c]).alias("n"))
        for c in CLASS_LABELS
    ]
    return kpi_row.select(F.inline(F.array(*rows)))


def score_histogram(final: DataFrame) -> DataFrame:
    """Rows per score, missing ones left out."""
    known = final.where(F.col(SCORE).isNotNull() & ~F.isnan(SCORE))
    return known.groupBy(SCORE).agg(_rows(known).alias("n"))


def display_names(table: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Columns renamed for presentation; names that are not there are ignored."""
    return table.withColumnsRenamed(headers)
