"""The stored review table: ranges of numbers, edits that go to them, and the hand-over in order."""

import pytest
from pyspark.sql import functions as F

from siftline.config import RESERVED, SCORE_COLUMNS
from siftline.operators import review as review_module
from siftline.operators.enrich import enrich_crowded
from siftline.operators.ordering import number_by_file, number_rows
from siftline.operators.review import REVIEW_PART, apply_review_edits, edited, review_parts, validate_edits
from siftline.plans import make_review, review_and_export, run_pipeline
from siftline.sources import read_handover


def leads(spark, n=300):
    need = F.when(F.col("id") % 7 == 0, "biệt thự").when(F.col("id") % 5 == 0, "thuê bao").otherwise("nhà")
    return spark.range(n).select(F.col("id").cast("string"), need.alias("nhu_cau_mo_ta"), F.lit("x").alias("note"))


@pytest.fixture
def review(spark, tmp_path):
    return make_review(run_pipeline(leads(spark).repartition(4), inline=True).stored, str(tmp_path / "review"))


EDITS = "row_id long, op string, id string, score string, note string"
ROWS = [(1, "update", None, "7", None), (2, "delete", None, None, None), (300, "update", None, None, "last")]
ROWS += [(None, "insert", f"new{k}", "50", None) for k in range(5)]
ROWS += [(301, "delete", None, None, None), (0, "update", None, "1", None), (-4, "delete", None, None, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_review_lies_in_ranges(spark, review):
    whole, ranges = review_parts(review)
    found = [tuple(r) for r in ranges.select(REVIEW_PART, "first", "n").orderBy(REVIEW_PART).collect()]
    assert sum(n for _, _, n in found) == 300 and [k for k, _, _ in found] == sorted(k for k, _, _ in found)
    start = 1
    for _, first, n in found:
        assert first == start
        start += n
    assert REVIEW_PART not in review.columns and REVIEW_PART in whole.columns
    assert review_parts(review.where("row_id > 3")) is None
    assert review_parts(review.withColumn("note", F.lit("y"))) is None
    assert review_parts(leads(spark)) is None


def test_unknown_rows_are_told_by_the_range(spark, review):
    edits = spark.createDataFrame(ROWS, EDITS)
    valid, rejected = validate_edits(edits, review)
    assert "row_id#" not in plan(valid).partition("Scan parquet")[2]
    assert {r.row_id for r in rejected.collect()} == {301, 0, -4}
    same, others = validate_edits(edits, review.where("row_id > 0"))
    assert sorted(map(str, same.collect())) == sorted(map(str, valid.collect()))
    assert sorted(map(str, others.collect())) == sorted(map(str, rejected.collect()))
    few = validate_edits(edits, review.where("row_id < 100"))[1]
    assert {r.row_id for r in few.collect()} == {300, 301, 0, -4}


def test_only_edits_move(spark, review):
    valid, _ = validate_edits(spark.createDataFrame(ROWS, EDITS), review)
    kept, new, n = edited(review_parts(review)[0], valid)
    assert n == 3 and "Exchange hashpartitioning" not in plan(kept) and "rangepartitioning" not in plan(kept)
    assert kept.count() == 299 and new.count() == 5


def handed(spark, path, format, schema):
    table = read_handover(spark, path, schema, format)
    return [tuple(r)[:-1] for r in number_by_file(table, "place").orderBy("place").collect()]


@pytest.mark.parametrize("format", ["parquet", "csv"])
@pytest.mark.parametrize("given", [True, False])
def test_the_order_of_the_hand_over(spark, review, tmp_path, format, given):
    edits = spark.createDataFrame(ROWS, EDITS) if given else None
    path, plain = str(tmp_path / "out"), str(tmp_path / "plain")
    rejected = review_and_export(review, path, edits, format)
    # A table that is not the stored one takes the range shuffle; both give the same rows in the same order.
    review_and_export(review.where("row_id > 0"), plain, edits, format)
    schema = review.drop("row_id").schema
    got = handed(spark, path, format, schema)
    assert len(got) == (304 if given else 300) and got == handed(spark, plain, format, schema)
    assert (rejected is None) == (not given)
    names = sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith("."))
    assert names[0] == "_SUCCESS" and all(x.startswith("part-0") for x in names[1:])
    with pytest.raises(Exception):
        review_and_export(review, path, edits, format)


def test_very_many_edits_take_the_other_way(spark, review, tmp_path, monkeypatch):
    edits = spark.createDataFrame(ROWS, EDITS)
    paths = [str(tmp_path / name) for name in "ab"]
    review_and_export(review, paths[0], edits)
    monkeypatch.setattr(review_module, "FEW_EDITS", 0)
    monkeypatch.setattr("siftline.plans.triage.FEW_EDITS", 0)
    review_and_export(review, paths[1], edits)
    schema = review.drop("row_id").schema
    assert handed(spark, paths[0], "parquet", schema) == handed(spark, paths[1], "parquet", schema)


def test_an_empty_review(spark, tmp_path):
    stored = run_pipeline(leads(spark).repartition(2), inline=True).stored.where("id is null")
    path = str(tmp_path / "none")
    stored.write.parquet(path)
    review = make_review(spark.read.schema(stored.schema).parquet(path))
    assert review.count() == 0
    review_and_export(review, str(tmp_path / "out"))
    assert read_handover(spark, str(tmp_path / "out"), review.drop("row_id").schema).count() == 0


HELPERS = ("_before", "_start", "_parts", "_crowd_id", "_lead_part", "_n", "_there", "_two", "_key")


def test_columns_named_like_helpers_keep_their_values(spark, tmp_path):
    table = leads(spark, 60).withColumns({c: F.concat(F.lit(c), "id") for c in HELPERS if c not in RESERVED})
    path = str(tmp_path / "helpers")
    table.repartition(3).write.parquet(path)
    stored = spark.read.parquet(path)

    def whole(result):
        assert result.count() == 60
        for c in HELPERS:
            assert result.where(F.col(c) != F.concat(F.lit(c), F.coalesce("of", "id"))).isEmpty(), c

    whole(run_pipeline(stored).final.withColumn("of", F.col("id")))
    unnumbered = stored.withColumnRenamed("id", "of")
    whole(run_pipeline(unnumbered).final)
    whole(run_pipeline(unnumbered, order_by=["of"], unique_order=True).final)
    whole(number_by_file(unnumbered, "id"))
    whole(number_rows(unnumbered, [F.col("of").asc()], "id"))
    scores = stored.select("id", F.lit(10.0).alias("score"), F.lit("WARM").alias("classification"), F.col("id").alias("reason"))
    crowd = enrich_crowded(stored.withColumn("id", F.lit("1")), scores.withColumn("id", F.lit("1")), crowd=10)
    assert crowd.count() == 3600 and set(HELPERS) < set(crowd.columns) and set(SCORE_COLUMNS) < set(crowd.columns)
    assert crowd.where(~F.col("_parts").startswith("_parts")).isEmpty()
    review = make_review(run_pipeline(stored, inline=True).stored, str(tmp_path / "review"))
    edits = spark.createDataFrame([(5, "update", "new")], "row_id long, op string, _there string")
    valid, _ = validate_edits(edits, review)
    assert apply_review_edits(review, valid).where("_there = 'new'").count() == 1
