"""Tables kept between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"

_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    path = spark.conf.get(SHARED_DIR, None)
    if not path:
        raise ValueError(f"set {SHARED_DIR} to a folder that all executors can reach")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet: in the run's own folder inside ``scratch``, else beside it."""
    return f"{_run.get() or shared_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A new folder that outlives the run."""
    return f"{shared_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to one folder, which is deleted at the end. Whatever is to stay
    is written to a path of its own. Runs inside a run share its folder."""
    if _run.get():
        yield _run.get()
        return
    path = kept_path(spark, "run")
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        delete(spark, path)


def fresh(table: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``table`` has, for helper columns on the way."""
    taken, found = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``. It is made and written if it is not there, or not whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize(
    table: DataFrame,
    path: str | None = None,
    name: str = "table",
    by: tuple[str, ...] = (),
    mode: str = "errorifexists",
) -> DataFrame:
    """Write ``table`` as parquet, in a folder for each value of ``by``, and return the written table.

    Later jobs read it and never compute it again. Unlike cached blocks it outlives its
    executors.
    """
    spark = table.sparkSession
    path = path or new_path(spark, name)
    table.write.mode(mode).partitionBy(*by).parquet(path)
    return spark.read.schema(table.schema).parquet(path)
