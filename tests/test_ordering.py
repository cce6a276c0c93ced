"""Row numbers, ids and batches."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline.operators.ordering import (
    NoStoredOrder,
    assign_batches,
    ensure_id,
    number_by_file,
    number_rows,
)
from siftline.operators.review import number_for_review
from siftline.sources import materialize

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_number_rows_equals_row_number(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "lang")
    order = [F.col("lang").desc(), F.col("doc_id").asc()]
    got = number_rows(docs, order, "n", unique=True)
    want = docs.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    assert got.select(want.columns).exceptAll(want).isEmpty()
    assert got.count() == want.count()


@pytest.mark.parametrize("scan", [True, False])
def test_ties_spread_and_stay_whole(spark, scan, tmp_path):
    """One value holds all rows: numbers are still 1..n and the work is cut into partitions."""
    df = spark.range(20_000).select(F.lit("same").alias("k"), (F.col("id") % 3).alias("v"))
    if scan:
        df = materialize(df, str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(df, [F.col("k")], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == ["k", "v", "n"]
    total = got.agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n"), F.sum("v")).first()
    assert tuple(total) == (20_000, 1, 20_000, 20_000, 19_999)
    sizes = got.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4_000


def test_number_by_file_keeps_stored_order(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = number_by_file(spark.read.parquet(str(tmp_path / "t")), "n")
    assert got.where("n <> id + 1").isEmpty() and got.count() == 1000
    for made in (spark.range(100), spark.read.parquet(str(tmp_path / "t")).groupBy("id").count()):
        with pytest.raises(NoStoredOrder):
            number_by_file(made, "n")


def test_number_by_file_has_no_sort_of_rows(spark):
    plan = number_by_file(spark.read.parquet(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_ensure_id(spark):
    docs = spark.read.parquet(DOCS).select("doc_id")
    got = ensure_id(docs, ["doc_id"], unique=True)
    assert dict(got.dtypes)["id"] == "string"
    assert got.where("cast(id as bigint) <> doc_id + 1").isEmpty()
    assert ensure_id(docs).where("cast(id as bigint) <> doc_id + 1").isEmpty()
    kept = ensure_id(spark.createDataFrame([(7,), (None,)], "id int"))
    assert {r.id for r in kept.collect()} == {"7", None}


def test_batches(spark):
    df = spark.range(45).select(F.col("id").alias("k"))
    got = assign_batches(df, ["k"], unique=True)
    assert got.where("batch_id <> k div 20 or pos <> k % 20").isEmpty()
    sizes = got.groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in sizes] == [(0, 20), (1, 20), (2, 5)]
    ready = df.withColumn("ordinal", F.col("k") + 1)
    assert assign_batches(ready, size=7).agg(F.max("batch_id")).first()[0] == 6


def test_review_numbers_follow_score(spark):
    df = spark.createDataFrame(
        [("b", None, 1), ("a", None, 2), ("c", -50.0, 3), ("d", 50.0, 4), ("a", 10.0, 5), ("n", float("nan"), 6)],
        "id string, score double, x int",
    )
    got = {r.x: r.row_id for r in number_for_review(df).collect()}
    assert got == {4: 1, 5: 2, 3: 3, 2: 4, 1: 5, 6: 6}


def uneven(spark, path, format):
    """Three files of 2, 5,000 and 1 rows, named a, b and c."""
    for name, low, high in (("a", 0, 2), ("b", 2, 5002), ("c", 5002, 5003)):
        writer = spark.range(low, high).coalesce(1).write
        writer.format(format).save(f"{path}/part={name}")
    return spark.read.schema("id bigint").format(format).load([f"{path}/part={x}" for x in "bca"])


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
@pytest.mark.parametrize("keep", ["id >= 0", "id % 3 = 0"])
def test_which_row_has_which_number(spark, tmp_path, format, keep):
    """The order is that of the source, row by row, whatever its format and filters."""
    read = uneven(spark, str(tmp_path), format).where(keep)
    got = {r.id: r.n for r in number_by_file(read, "n").collect()}
    want = [i for i in range(5003) if keep == "id >= 0" or i % 3 == 0]
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_a_path_given_twice(spark, tmp_path):
    """Every listing of a row has a number of its own; the two stand side by side."""
    path = str(tmp_path / "t")
    spark.range(500).coalesce(1).write.parquet(path)
    got = number_by_file(spark.read.parquet(path, path), "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1001)) and all((r.n - 1) // 2 == r.id for r in got)


@pytest.mark.parametrize("change", ["filter", "join", "explode", "limit", "csv", "table"])
def test_stored_order_of_derived_tables(spark, change, tmp_path):
    """Rows taken out or multiplied after the scan still get 1..n."""
    path = str(tmp_path / "t")
    spark.range(300).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path)
    if change == "filter":
        df = df.where("id % 2 = 0")
    elif change == "join":
        twice = spark.createDataFrame([(0,), (1,), (1,)], "k int")
        df = df.join(F.broadcast(twice), F.col("id") % 3 == F.col("k")).drop("k")
    elif change == "explode":
        df = df.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")).drop("x")
    elif change == "limit":
        df = df.limit(37)
    elif change == "csv":
        df.write.csv(str(tmp_path / "c"))
        df = spark.read.schema("id bigint").csv(str(tmp_path / "c"))
    elif change == "table":
        df.write.saveAsTable("stored_order")
        df = spark.table("stored_order")
    n = df.count()
    got = number_by_file(df, "n").agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (n, 1, n, n)
