"""Repair, edits and hand-over."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import coerce_score, format_rate, parse_number
from siftline.operators.enrich import enrich_compact
from siftline.operators.metrics import kpis
from siftline.operators.review import (
    apply_review_edits,
    number_for_review,
    repair_for_review,
    review_order,
    validate_edits,
)
from siftline.operators.rules import score_leads
from siftline.plans import export_result, make_review, review_and_export
from siftline.sources import export_handover, materialize, read_handover

NEUTRAL = "Lead bình thường (nhu cầu hợp lý)"
FINAL = "id string, score double, classification string, reason string"


def test_coerce_score(spark):
    cases = {
        "50": 50, " 10 ": 10, "1e2": 100, "-50.9": -50, "49.9": 49, "12abc": 10, "": 10, None: 10,
        "nan": 10, "0x1F": 10, "1_0": 10, "50d": 10, "Infinity": 10, "1e400": 10, "9e18": 9 * 10**18, "1e19": 10, "-1e19": 10,
        ".5": 0, "5.": 5, "2147483647": 2147483647, "2147483648": 2147483648, "-2147483648": -2147483648, "3000000000": 3000000000, "+7": 7,
        "1f": 10, "\t8\n": 8, ".": 10, "e5": 10,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.v for r in df.select("s", coerce_score(F.col("s")).alias("v")).collect()}
    assert got == cases
    numbers = spark.createDataFrame([(49.9,), (None,), (float("nan"),), (float("-inf"),), (1e10,)], "s double")
    assert [r.v for r in numbers.select(coerce_score(F.col("s")).alias("v")).collect()] == [49, 10, 10, 10, 10**10]
    assert dict(numbers.select(parse_number(F.col("s")).alias("v")).dtypes) == {"v": "double"}


def test_order_and_kpis_come_before_repair(spark):
    final = spark.createDataFrame(
        [("1", 50.0, "HOT", "a"), ("2", -50.0, "JUNK", "b"), ("3", 10.0, "Warm", "c"), ("4", None, None, None),
         ("5", None, None, None)],
        FINAL,
    )
    assert [r.id for r in review_order(final).collect()] == ["1", "3", "2", "4", "5"]
    review = repair_for_review(number_for_review(final)).orderBy("row_id")
    assert [(r.id, r.row_id, r.score, r.classification) for r in review.collect()] == [
        ("1", 1, 50, "HOT"), ("3", 2, 10, "WARM"), ("2", 3, -50, "JUNK"), ("4", 4, 10, "WARM"), ("5", 5, 10, "WARM")
    ]
    assert review.where("id = '4'").first().reason == NEUTRAL
    assert dict(review.dtypes)["score"] == "bigint"
    assert kpis(final).first().warm == 0


def test_repair_guards_missing_columns(spark):
    df = spark.createDataFrame([(None, 7)], "sdt string, other int")
    assert [tuple(r) for r in repair_for_review(df).collect()] == [("", 7)]
    mixed = spark.createDataFrame([("50",), ("x",), (None,)], "score string")
    assert [r.score for r in repair_for_review(mixed).collect()] == [50, 10, 10]
    assert [r.score for r in review_order(mixed.withColumn("id", F.lit("1"))).collect()][0] == "50"


@pytest.mark.parametrize("rate, shown", [(6.25, "6.2"), (12.35, "12.4"), (78.5714, "78.6"), (0.0, "0.0"), (100.0, "100.0")])
def test_format_rate(spark, rate, shown):
    df = spark.createDataFrame([(rate,)], "r double")
    assert df.select(format_rate(F.col("r"))).first()[0] == shown


EDITS = "row_id bigint, op string, id string, score string, classification string, reason string"


def test_review_edits(spark):
    review = spark.createDataFrame(
        [(1, "A", 50, "HOT"), (2, "B", 10, "WARM"), (3, "B", 10, "WARM"), (4, "C", -50, "JUNK")],
        "row_id bigint, id string, score int, classification string",
    )
    edits = spark.createDataFrame(
        [(2, "update", None, "50", "HOT", None), (4, "delete", None, None, None, None),
         (None, "insert", "D", "10", "WARM", None), (1, "update", None, "5", "Hot", None)],
        EDITS,
    )
    valid, rejected = validate_edits(edits, review)
    assert [(r.row_id, r.rejected) for r in rejected.collect()] == [(1, "unknown class")]
    got = apply_review_edits(review, valid)
    assert got.schema == review.schema
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(
        map(str, [(1, "A", 50, "HOT"), (2, "B", 50, "HOT"), (3, "B", 10, "WARM"), (None, "D", 10, "WARM")])
    )


def test_edit_checks(spark):
    review = spark.createDataFrame(
        [(i, "A", 10, "WARM", 1.5, "x") for i in range(1, 9)], "row_id bigint, id string, score bigint, classification string, size double, reason string"
    )
    edits = spark.createDataFrame(
        [(1, "update", None, "5.5", None, None, None), (1, "update", None, "x", None, None, None), (None, "delete", None, None, None, None, None),
         (1, "merge", None, None, None, None, None), (1, None, None, None, None, None, None), (2, "update", None, "7.0", "ok", None, None),
         (3, "update", None, "1e2", None, None, None), (4, "update", None, "1e30", None, None, None), (5, "update", "B", None, None, None, None),
         (6, "update", None, None, None, "2.5", None), (7, "update", None, None, None, "wide", None), (99, "delete", None, None, None, None, None),
         (8, "update", None, "3000000000", None, None, ["reason", "size"])],
        "row_id bigint, op string, id string, score string, reason string, size string, cleared array<string>",
    )
    valid, rejected = validate_edits(edits.where("row_id <> 1 or op = 'merge' or row_id is null or op is null"), review)
    assert sorted((str(r.row_id), r.rejected) for r in rejected.collect()) == [
        ("1", "unknown operation"), ("1", "unknown operation"), ("4", "score is no integer"), ("5", "locked column"), ("7", "unreadable size"),
        ("99", "unknown row"), ("None", "no row"),
    ]
    got = {r.row_id: (r.score, r.reason, r.size) for r in apply_review_edits(review, valid).collect()}
    assert got == {1: (10, "x", 1.5), 2: (7, "ok", 1.5), 3: (100, "x", 1.5), 4: (10, "x", 1.5), 5: (10, "x", 1.5), 6: (10, "x", 2.5),
                   7: (10, "x", 1.5), 8: (3_000_000_000, None, None)}
    two = spark.createDataFrame([(1, "update", "5"), (1, "update", "6"), (2, "update", "7")], "row_id bigint, op string, score string")
    valid, rejected = validate_edits(two, review)
    assert [r.score for r in valid.collect()] == ["7"] and {r.rejected for r in rejected.collect()} == {"two values and no order"}
    valid, rejected = validate_edits(two.select("row_id", "op"), review)
    assert valid.count() == 3 and rejected.isEmpty()


def test_several_edits_of_one_row(spark):
    review = spark.createDataFrame([(1, "A", 10, "WARM"), (2, "B", 10, "WARM")], "row_id bigint, id string, score int, classification string")
    edits = spark.createDataFrame(
        [(1, "update", "Z", "40", None, 1), (1, "update", None, "30", None, 2), (1, "update", None, None, "HOT", 0),
         (2, "delete", None, None, None, 1), (2, "update", None, "5", None, 2)],
        "row_id bigint, op string, id string, score string, classification string, edit_seq int",
    )
    assert [tuple(r) for r in apply_review_edits(review, edits).collect()] == [(1, "A", 30, "HOT")]


TEXTS = ["biệt thự\nven sông", 'nói "20 tỷ", thật', "", None, "thuê bao\r\nkhông", "back\\slash, \"", " lead ", "'q'", "\n x \t\n", "\\"]


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_handover_round_trip(spark, tmp_path, format):
    leads = spark.createDataFrame([(str(i % 5), t, i) for i, t in enumerate(TEXTS)], "id string, nhu_cau_mo_ta string, extra int")
    stored = materialize(enrich_compact(leads, score_leads(leads)))
    path = str(tmp_path / "out")
    export_result(stored, path, format)
    review = repair_for_review(number_for_review(stored, written=True)).orderBy("row_id").drop("row_id")
    back = read_handover(spark, path, review.schema, format)
    assert back.count() == 20
    assert back.exceptAll(review).isEmpty() and review.exceptAll(back).isEmpty()
    files = sorted((tmp_path / "out").glob("part-*"))
    in_order = [r for f in files for r in read_handover(spark, str(f), review.schema, format).collect()]
    assert in_order == review.collect()


def test_handover_with_edits(spark, tmp_path):
    leads = spark.createDataFrame([("1", "penthouse"), ("2", "thuê bao"), ("3", "nhà")], "id string, nhu_cau_mo_ta string")
    stored = materialize(enrich_compact(leads, score_leads(leads)))
    edits = spark.createDataFrame(
        [(2, "update", None, "50", "HOT", "gặp"), (3, "delete", None, None, None, None), (None, "insert", "9", "10", "WARM", "mới"),
         (1, "update", None, None, "hot", None)],
        EDITS,
    )
    path = str(tmp_path / "out")
    rejected = review_and_export(make_review(stored), path, edits)
    assert [r.row_id for r in rejected.collect()] == [1]
    got = [(r.id, r.score, r.classification, r.reason) for f in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert got == [
        ("1", 50, "HOT", "VIP: Chứa từ khóa 'penthouse'"), ("3", 50, "HOT", "gặp"), ("9", 10, "WARM", "mới")
    ]
    assert kpis(stored).first().junk == 1


def test_export_of_numbered_table(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, "z")], "row_id bigint, id string")
    path = export_handover(df, str(tmp_path / "x"))
    assert spark.read.parquet(path).columns == ["id"]
