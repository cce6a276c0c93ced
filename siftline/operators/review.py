"""Review order, repair, and the reviewers' edits as a data overlay."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, NumericType, StructField, StructType

from siftline.config import CLASS, CLASSES, COPIES, ID, NAME, NEED, PHONE, REASON, SCORE
from siftline.functions.repair import (
    LONG_LIMIT,
    coerce_class,
    coerce_score,
    fill_reason,
    fill_text,
    parse_number,
)
from siftline.operators.enrich import COPY_NO, expand_copies
from siftline.operators.ordering import TIE, number_rows, with_tie_break
from siftline.sources.handover import ROW_ID
from siftline.sources.store import fresh, materialize

OP = "op"
EDIT_SEQ = "edit_seq"
UPDATE = "update"
DELETE = "delete"
INSERT = "insert"
# Names of the cells of an update that are to be emptied.
CLEARED = "cleared"
LOCKED = (ID, NEED)
# The range of numbers that a stored review row is in.
REVIEW_PART = "review_part"
# As many edited rows are sent to every task; with more, rows and edits are joined by shuffling.
FEW_EDITS = 100_000


def score_is_number(table: DataFrame) -> bool:
    return isinstance(table.schema[SCORE].dataType, NumericType)


def score_order(final: DataFrame) -> list[Column]:
    """Highest score first, missing last, then by id. Scores count as they were before repair."""
    score = parse_number(F.col(SCORE), score_is_number(final))
    order = [score.desc_nulls_last()]
    return [*order, F.col(ID).asc_nulls_last()] if ID in final.columns else order


def spread_copies(final: DataFrame, written: bool = False) -> tuple[DataFrame, list[Column]]:
    """The full table with an order that puts equal rows apart, so that a score or an id shared
    by very many rows can be cut anywhere, and the helper columns to drop: ``_tie``, ``_copy``.
    ``written`` says that ``final`` is a written table as it stands."""
    placed = with_tie_break(final, written)
    order = [*score_order(final), F.col(TIE).asc()]
    if COPIES not in placed.columns:
        return placed, order
    return expand_copies(placed, numbered=True, spread=True), [*order, F.col(COPY_NO).asc()]


def review_order(final: DataFrame, written: bool = False) -> DataFrame:
    """The full table sorted for review."""
    full, order = spread_copies(final, written)
    return full.orderBy(*order).drop(TIE, COPY_NO)


def number_for_review(final: DataFrame, written: bool = False, part: str | None = None) -> DataFrame:
    """The full table with ``row_id`` 1..n in review order. Edits refer to rows by it, since an
    id may stand in several rows. ``part`` names a column for the range of numbers a row is in."""
    full, order = spread_copies(final, written)
    return number_rows(full, order, ROW_ID, unique=True, part=part).drop(TIE, COPY_NO)


def store_review(review: DataFrame, path: str) -> DataFrame:
    """Write a numbered table in one folder a range of numbers (column ``review_part``), and beside it
    the first number and the length of each range. Rows do not move: a range lies in few files."""
    columns = [c for c in review.columns if c != REVIEW_PART]
    sorted_ = review.sortWithinPartitions(REVIEW_PART, ROW_ID)
    sorted_.write.mode("errorifexists").partitionBy(REVIEW_PART).parquet(f"{path}/rows")
    stored = _parts(review.sparkSession, path, review.select(*columns).schema)
    # By the name that its files give it, so that the same table can be told again.
    path = _folder(stored) or path
    stored = _parts(review.sparkSession, path, review.select(*columns).schema)
    ranges = stored.groupBy(REVIEW_PART).agg(F.min(ROW_ID).alias("first"), F.count("*").alias("n"))
    ranges.coalesce(1).write.mode("errorifexists").parquet(f"{path}/ranges")
    return stored.select(*columns)


def _folder(review: DataFrame) -> str | None:
    """Where a stored review table lies."""
    files = review.inputFiles()
    found = re.fullmatch(rf"(.*)/rows/{REVIEW_PART}=\d+/[^/]*", unquote(files[0])) if files else None
    return found and found[1]


def _parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    fields = [StructField(f.name, f.dataType) for f in schema]
    part = StructField(REVIEW_PART, IntegerType())
    return spark.read.schema(StructType([*fields, part])).parquet(f"{path}/rows")


def review_parts(review: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """A review table as ``store_review`` gave it: with the column ``review_part``, and its ranges. None
    for any other table, filtered or changed ones too."""
    spark, path = review.sparkSession, _folder(review)
    if not path:
        return None
    whole = _parts(spark, path, review.schema)
    if not whole.select(*review.columns).sameSemantics(review):
        return None
    return whole, spark.read.parquet(f"{path}/ranges")


def repair_for_review(final: DataFrame) -> DataFrame:
    """Every handled column that is present made complete and valid."""
    repairs = {
        ID: fill_text,
        NAME: fill_text,
        PHONE: fill_text,
        NEED: fill_text,
        SCORE: lambda c: coerce_score(c, numeric=score_is_number(final)),
        CLASS: coerce_class,
        REASON: fill_reason,
    }
    return final.withColumns(
        {c: repair(F.col(c)) for c, repair in repairs.items() if c in final.columns}
    )


def validate_edits(edits: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of ``review`` that may be applied, and the others with the reason in ``rejected``.

    Only columns that are there are checked. Rejected are: operations and classes that are none,
    updates and deletes without a row or of a row that the review table has not, scores that are no
    64-bit whole number, values that do not fit the type of their column, updates of locked
    columns, and, where no ``edit_seq`` orders them, updates of a row that give a cell two
    values.
    """
    types = dict(review.dtypes)
    given = [c for c in edits.columns if c in types and c != ROW_ID]
    parts = review_parts(review)
    there, two_values = fresh(edits, "_there", "_two")
    if parts:
        # Numbers run from 1 without a gap: how many there are is all that is asked of the table.
        rows = parts[1].agg(F.sum("n")).first()[0] or 0
        table = edits.withColumn(there, F.when(F.col(ROW_ID).between(1, rows), F.lit(True)))
    else:
        table = edits.join(review.select(ROW_ID, F.lit(True).alias(there)).distinct(), ROW_ID, "left")
    change = F.coalesce(F.col(OP).isin(UPDATE, DELETE), F.lit(False))
    update = F.coalesce(F.col(OP) == UPDATE, F.lit(False))
    checks = [
        (~F.coalesce(F.col(OP).isin(UPDATE, DELETE, INSERT), F.lit(False)), "unknown operation"),
        (change & F.col(ROW_ID).isNull(), "no row"),
        (change & F.col(there).isNull(), "unknown row"),
    ]
    if SCORE in edits.columns:
        score = F.col(SCORE)
        number = parse_number(score)
        whole = F.coalesce((number == F.floor(number)) & (F.abs(number) < LONG_LIMIT), F.lit(False))
        checks.append((score.isNotNull() & ~whole, "score is no integer"))
    if CLASS in edits.columns:
        checks.append((F.col(CLASS).isNotNull() & ~F.col(CLASS).isin(*CLASSES), "unknown class"))
    locked = [c for c in given if c in LOCKED]
    if locked:
        touched = F.coalesce(*[F.col(c).cast("string") for c in locked]).isNotNull()
        checks.append((update & touched, "locked column"))
    for c in given:
        if c not in (SCORE, CLASS) and types[c] != "string":
            checks.append((F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull(), f"unreadable {c}"))
    if EDIT_SEQ not in edits.columns and (cells := [c for c in given if c not in LOCKED]):
        two = F.lit(False)
        for c in cells:
            two = two | F.coalesce(F.min(c) != F.max(c), F.lit(False))
        twice = edits.where(update).groupBy(ROW_ID).agg(two.alias(two_values))
        table = table.join(twice.where(F.col(two_values)), ROW_ID, "left")
        checks.append((update & F.coalesce(two_values, F.lit(False)), "two values and no order"))
    found = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])
    checked = table.withColumn("rejected", found).select(*edits.columns, "rejected")
    valid = checked.where(F.col("rejected").isNull()).drop("rejected")
    return valid, checked.where(F.col("rejected").isNotNull())


def one_edit_per_row(edits: DataFrame, columns: list[str]) -> DataFrame:
    """Updates and deletes with one row per ``row_id``: a delete wins, else the last value given
    for each cell (by ``edit_seq`` where there is one). Combines map-side."""
    seq = F.col(EDIT_SEQ) if EDIT_SEQ in edits.columns else F.lit(0)
    clears = CLEARED in edits.columns

    def last(c: str) -> Column:
        """The last value, or NULL in a struct for a cell that was emptied after it."""
        empty = F.coalesce(F.array_contains(CLEARED, c), F.lit(False)) if clears else F.lit(False)
        value = F.struct(F.when(~empty, F.col(c)).alias("value"))
        return F.max_by(value, F.when(empty | F.col(c).isNotNull(), F.struct(seq, ~empty, F.col(c))))

    return (
        edits.where(F.col(OP).isin(UPDATE, DELETE))
        .groupBy(ROW_ID)
        .agg(
            F.bool_or(F.col(OP) == DELETE).alias("_deleted"),
            *[last(c).alias(f"_new_{c}") for c in columns],
        )
    )


def apply_review_edits(review: DataFrame, edits: DataFrame) -> DataFrame:
    """The review table after the edits; inserted rows have no ``row_id``."""
    kept, new, _ = edited(review, edits)
    return kept.unionByName(new)


def edited(review: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows of the review table after the edits, the inserted rows, which have no ``row_id``, and the
    number of rows that were updated or deleted.

    A cell of an update that is NULL leaves the value as it is. ``id`` and the description are
    locked: updates do not touch them.

    A column named in ``cleared`` (an array of names) becomes NULL. One left join brings updates and
    deletes; their table is written first, so that Spark broadcasts it if it is small. Numbers
    given as text (``50.0``, ``1e2``) are taken by their value.
    """
    editable = [
        c
        for c in review.columns
        if c not in (*LOCKED, ROW_ID, REVIEW_PART) and (c in edits.columns or CLEARED in edits.columns)
    ]
    types = dict(review.dtypes)

    def typed(c: str) -> Column:
        if c not in edits.columns:
            return F.lit(None).cast(types[c])
        if c == SCORE and types[c] != "string":
            return parse_number(F.col(c)).cast(types[c])
        return F.col(c).cast(types[c])

    taken = edits.withColumns({c: typed(c) for c in editable}) if editable else edits
    changes = materialize(one_edit_per_row(taken, editable), name="edits")
    n = changes.count()
    if n <= FEW_EDITS:
        changes = F.broadcast(changes)
    joined = review.join(changes, ROW_ID, "left").where(~F.coalesce("_deleted", F.lit(False)))
    kept = joined.select(
        *[
            F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.value")).otherwise(F.col(c)).alias(c)
            if c in editable
            else c
            for c in review.columns
        ]
    )
    new = taken.where(F.col(OP) == INSERT).select(
        *[
            (F.col(c) if c in taken.columns and c != ROW_ID else F.lit(None)).cast(types[c]).alias(c)
            for c in review.columns
        ]
    )
    return kept, new, n
