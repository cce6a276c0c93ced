"""Writing the reviewed table for hand-over, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import ID, LEAD_COLUMNS, NAME, NEED, PHONE, REASON, SCORE_COLUMNS
from siftline.sources.leads import CSV_OPTIONS, CSV_WRITE_OPTIONS
from siftline.sources.store import fresh

# Place in review order; not handed over.
ROW_ID = "row_id"


def arrange(table: DataFrame, order_by: list[Column]) -> DataFrame:
    """``table`` range-partitioned and sorted. ``order_by`` should tell all rows apart, so that
    no value is too common to be cut."""
    return table.repartitionByRange(*order_by).sortWithinPartitions(*order_by)


def export_handover(
    table: DataFrame, path: str, format: str = "parquet", arranged: bool = False
) -> str:
    """Write ``table`` in row-number order, inserted rows (which have none) last, by id; return
    ``path``.

    ``arranged`` tables are written as they stand. There is one file per partition, each with the
    header: file names follow the order and each file is sorted, so reading the files by name
    gives the whole order.
    """
    if not arranged:
        known = [c for c in (*LEAD_COLUMNS, *SCORE_COLUMNS) if c in table.columns]
        order = [F.col(ROW_ID).asc_nulls_last(), *[F.col(c) for c in known if c == ID]]
        # Inserted rows share the missing number; their content spreads them.
        table = arrange(table, [*order, F.xxhash64(*known)] if known else order)
    writer = table.drop(ROW_ID).write.mode("errorifexists")
    if format == "csv":
        writer = writer.options(**CSV_WRITE_OPTIONS)
    writer.format(format).save(path)
    return path


def export_parts(
    table: DataFrame, new: DataFrame, part: str, parts: int, path: str, format: str = "parquet"
) -> str:
    """Write ``table``, whose rows lie together by ``part`` (0 to ``parts`` - 1, in row-number order), and
    the rows ``new`` after them, by id; return ``path``.

    Files and their names are as ``export_handover`` writes them, but only the new rows move. A task
    sorts what it has read and writes each part to a folder of its own; at the end the files are renamed, in
    the order of their folders, and then a mark tells that the hand-over is whole.
    """
    spark = table.sparkSession
    known = [c for c in (*LEAD_COLUMNS, *SCORE_COLUMNS) if c in table.columns]
    order = [F.col(c) for c in known if c == ID] + ([F.xxhash64(*known)] if known else [])
    if order:
        new = new.repartitionByRange(*order)
    (key,) = fresh(table, "_key")
    new = new.withColumns({part: F.lit(parts) + F.spark_partition_id(), key: F.xxhash64(*known) if known else F.lit(0)})
    both = table.withColumn(key, F.lit(0).cast("bigint")).unionByName(new)
    ids = [ID] if ID in known else []
    both = both.sortWithinPartitions(part, ROW_ID, *ids, key).drop(ROW_ID, key)
    writer = both.write.mode("errorifexists").partitionBy(part)
    if format == "csv":
        writer = writer.options(**CSV_WRITE_OPTIONS)
    fs, folder = _folder(spark, path)
    if fs.exists(folder):
        raise FileExistsError(path)
    inner = f"{path}/_parts"
    writer.format(format).save(inner)
    _, top = _folder(spark, inner)
    found = sorted(
        (int(d.getPath().getName().split("=")[1]), f.getPath().getName(), f.getPath())
        for d in fs.listStatus(top) if d.isDirectory() and "=" in d.getPath().getName()
        for f in fs.listStatus(d.getPath())
    )
    for number, (_, name, file) in enumerate(found):
        # part-00003-<job>...: the number becomes the place of the file.
        _, target = _folder(spark, f"{path}/part-{number:05d}-{name.split('-', 2)[2]}")
        fs.rename(file, target)
    fs.delete(top, True)
    fs.create(_folder(spark, f"{path}/_SUCCESS")[1]).close()
    return path


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def read_handover(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """Hand-over table as written. CSV has no empty text, only missing cells, so missing text in
    columns that were repaired before the export is empty text again."""
    reader = spark.read.schema(schema)
    if format != "csv":
        return reader.format(format).load(path)
    table = reader.options(**CSV_OPTIONS).csv(path)
    text = [c for c in (NAME, PHONE, NEED, REASON) if c in table.columns]
    return table.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in text})
