"""Row numbers and batches in row order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import BATCH_SIZE, ID
from siftline.sources.store import fresh, materialize

ORDINAL = "ordinal"
BATCH_ID = "batch_id"
POSITION = "pos"

_PART = "_part"
_IN_PART = "_in_part"
_FILE = "_file"
_FILE_ROW = "_file_row"
TIE = "_tie"

_BLOCK = "_block"


class NoStoredOrder(ValueError):
    """Rows that were not read from files have no order but one by named columns."""


def with_file_position(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``table`` with the place each row was read from, and the names of the columns that hold it.

    Parquet knows the row's number in its file. Rows of other files are written once, with the file,
    the block of it and the order in which the task read them; so the numbers cannot change
    when a task is run again. Filters and projections keep the place. Rows of a join come from the
    place of its first files, if any; aggregates and rows made up have none and raise
    ``NoStoredOrder``.
    """
    file = F.col("_metadata.file_path").alias(_FILE)
    try:
        return table.select("*", file, F.col("_metadata.row_index").alias(_FILE_ROW)), [_FILE, _FILE_ROW]
    except AnalysisException:
        pass  # no files, or files whose rows have no number
    try:
        read = table.select("*", file, F.col("_metadata.file_block_start").alias(_BLOCK))
    except AnalysisException as e:
        raise NoStoredOrder("the rows have no stored order: name order_by") from e
    placed = read.withColumn(_FILE_ROW, F.monotonically_increasing_id())
    return materialize(placed, name="read"), [_FILE, _BLOCK, _FILE_ROW]


def with_tie_break(table: DataFrame, written: bool = False) -> DataFrame:
    """``table`` with a number in ``_tie`` that tells equal rows apart and never changes. It is
    written first, unless it is a written table as it stands."""
    placed, where = with_file_position(table if written else materialize(table, name="ties"))
    return placed.withColumn(TIE, F.xxhash64(*where)).drop(*where)


def number_by_file(table: DataFrame, name: str = ORDINAL) -> DataFrame:
    """Number rows 1..n in the order they are stored: by file name, then by row in the file.

    Whole parquet files are neither sorted nor shuffled: rows per file come from a scan without
    data columns, and a running total goes over one row a file. Where rows are missing or
    multiplied (a filter, a path given twice), or files of another kind were read, the rows are
    sorted by their place; rows of the same place stand side by side in any order.
    """
    placed, where = with_file_position(table)
    if where != [_FILE, _FILE_ROW]:
        return number_rows(placed, [F.col(c).asc() for c in where], name, unique=True).drop(*where)
    sizes = placed.groupBy(_FILE).agg(
        F.count("*").alias("_n"), (F.max(_FILE_ROW) + 1).alias("_rows"), F.sum(F.col(_FILE_ROW).cast("decimal(38,0)")).alias("_sum")
    )
    sizes = materialize(sizes, name="files")
    whole = (F.col("_n") == F.col("_rows")) & (F.col("_sum") * 2 == F.col("_n").cast("decimal(19,0)") * (F.col("_n") - 1))
    if not sizes.where(~whole).isEmpty():
        return number_rows(placed, [F.col(c).asc() for c in where], name, unique=True).drop(*where)
    (start,) = fresh(placed, "_before")
    by_name = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(_FILE, F.coalesce(F.sum("_n").over(by_name), F.lit(0)).alias(start))
    numbered = placed.join(before, _FILE)
    return numbered.withColumn(name, F.col(start) + F.col(_FILE_ROW) + 1).drop(*where, start)


def number_rows(
    table: DataFrame,
    order_by: list[Column],
    name: str = ORDINAL,
    unique: bool = False,
    written: bool = False,
    part: str | None = None,
) -> DataFrame:
    """Number rows 1..n in the given order without one task that sees all rows. ``part`` names a
    column for the number of the range that a row is in.

    Rows are range-partitioned and sorted, then written with their partition and their place in
    it. The written table is what makes the numbers stable: range bounds are sampled, so a second
    run may cut elsewhere. Counts per partition, one number each, give the offsets.

    ``order_by`` that may have ties (``unique=False``) is completed by the stored position of each
    row, so that a value shared by very many rows still spreads over many partitions.
    """
    spark = table.sparkSession
    if not unique:
        table = with_tie_break(table, written)
        order_by = [*order_by, F.col(TIE).asc()]
    ordered = table.repartitionByRange(*order_by).sortWithinPartitions(*order_by).drop(TIE)
    placed = ordered.withColumns(
        {
            _PART: F.spark_partition_id(),
            _IN_PART: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    stored = materialize(placed, name="numbered")
    sizes = sorted(stored.groupBy(_PART).agg(F.count("*")).collect())
    starts = accumulate((n for _, n in sizes), initial=1)
    (first,) = fresh(stored, "_start")
    offsets = spark.createDataFrame(
        [(k, start) for (k, _), start in zip(sizes, starts)], f"{_PART} int, {first} bigint"
    )
    numbered = stored.join(F.broadcast(offsets), _PART)
    numbered = numbered.withColumn(name, F.col(first) + F.col(_IN_PART)).drop(_IN_PART, first)
    return numbered.withColumnRenamed(_PART, part) if part else numbered.drop(_PART)


def number(
    table: DataFrame,
    order_by: list[str] | None,
    name: str = ORDINAL,
    unique: bool = False,
    written: bool = False,
) -> DataFrame:
    """Number rows 1..n by the named columns, or in stored order when none are named."""
    if not order_by:
        return number_by_file(table, name)
    return number_rows(table, [F.col(c).asc_nulls_last() for c in order_by], name, unique, written)


def ensure_id(
    leads: DataFrame, order_by: list[str] | None = None, unique: bool = False
) -> DataFrame:
    """``id`` as string; where the column is missing, 1..n in row order."""
    if ID not in leads.columns:
        leads = number(leads, order_by, ID, unique)
    return leads.withColumn(ID, F.col(ID).cast("string"))


def assign_batches(
    leads: DataFrame,
    order_by: list[str] | None = None,
    size: int = BATCH_SIZE,
    unique: bool = False,
    written: bool = False,
) -> DataFrame:
    """Consecutive batches of ``size`` rows: ``batch_id`` from 0, ``pos`` in the batch from 0.

    Uses an ``ordinal`` column that is already there, else numbers the rows first. A row without a
    number in such a column would be in no batch; it makes the job fail.
    """
    if ORDINAL in leads.columns:
        none = F.raise_error(F.lit(f"a lead has no {ORDINAL}"))
        leads = leads.withColumn(ORDINAL, F.coalesce(F.col(ORDINAL).cast("bigint"), none.cast("bigint")))
    else:
        leads = number(leads, order_by, unique=unique, written=written)
    return leads.withColumns(
        {
            BATCH_ID: F.expr(f"({ORDINAL} - 1) div {size}"),
            POSITION: F.expr(f"cast(({ORDINAL} - 1) % {size} as int)"),
        }
    )
