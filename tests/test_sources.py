"""Reading leads, keeping tables, session settings."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siftline.operators.rules import ColumnClash
from siftline.plans import dashboard, make_review, review_and_export, run_pipeline
from siftline.sources import (
    EmptyLeads,
    materialize,
    read_leads,
    require_rows,
    row_count,
    shared_dir,
)
from siftline.sources.store import new_path

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_lead_columns_are_text(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, 84901, "x", 2.5)], "id int, sdt bigint, nhu_cau_mo_ta string, extra double").write.parquet(path)
    leads = read_leads(spark, path)
    assert leads.dtypes == [("id", "string"), ("sdt", "string"), ("nhu_cau_mo_ta", "string"), ("extra", "double")]
    assert leads.first().sdt == "84901"


def test_csv_by_header_and_by_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,sdt,nhu_cau_mo_ta,extra\n1,0901,"hai\ndòng, ""ngoặc""",7\n2,,,8\n', "utf-8")
    leads = read_leads(spark, str(tmp_path / "a.csv"), "csv")
    assert [tuple(r) for r in leads.orderBy("id").collect()] == [("1", "0901", 'hai\ndòng, "ngoặc"', "7"), ("2", None, None, "8")]
    typed = read_leads(spark, str(tmp_path / "a.csv"), "csv", "id string, sdt string, nhu_cau_mo_ta string, extra int")
    assert dict(typed.dtypes)["extra"] == "int"


def test_other_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "id string, nhu_cau_mo_ta string")
    for format in ("json", "orc"):
        df.write.format(format).save(str(tmp_path / format))
        assert [tuple(r) for r in read_leads(spark, str(tmp_path / format), format).select("id", "nhu_cau_mo_ta").collect()] == [("1", "a")]
    df.write.saveAsTable("lead_table")
    assert row_count(read_leads(spark, "lead_table", "table")) == 1


def test_every_read_is_fresh(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("1",)], "id string")
    df.write.parquet(path)
    assert row_count(read_leads(spark, path)) == 1
    df.write.mode("append").parquet(path)
    assert row_count(read_leads(spark, path)) == 2


def test_nothing_is_kept_of_a_bad_load(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, nhu_cau_mo_ta string")
    for leads in (None, empty):
        with pytest.raises(EmptyLeads):
            require_rows(leads)
        with pytest.raises(EmptyLeads):
            run_pipeline(leads, path=str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        read_leads(spark, str(tmp_path / "nowhere"))
    assert not (tmp_path / "out").exists()


@pytest.mark.parametrize("name", ["Score", "reason", "row_id", "_copies", "ordinal"])
def test_taken_names_are_rejected(spark, name):
    with pytest.raises(ColumnClash):
        run_pipeline(spark.createDataFrame([("1", "x")], f"id string, {name} string"))


def test_materialized_table_does_not_compute_again(spark, tmp_path):
    table = spark.range(10).withColumn("r", F.rand())
    kept = materialize(table, str(tmp_path / "t"))
    assert kept.collect() == kept.collect() and kept.dtypes == table.dtypes
    with pytest.raises(AnalysisException):
        materialize(table, str(tmp_path / "t"))


def test_shared_folder_is_the_one_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and new_path(spark, "x").startswith(named + "/")


def test_a_run_leaves_only_its_results(spark, tmp_path):
    from pathlib import Path

    leads = spark.createDataFrame([("1", "penthouse"), ("1", "nhà"), ("2", "thuê bao")], "id string, nhu_cau_mo_ta string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    result = run_pipeline(leads)
    assert len(set(folder.iterdir()) - before) == 1
    review = make_review(result.stored)
    assert len(set(folder.iterdir()) - before) == 2
    edits = spark.createDataFrame([(1, "delete"), (99, "delete")], "row_id bigint, op string")
    rejected = review_and_export(review, str(tmp_path / "out"), edits)
    assert len(set(folder.iterdir()) - before) == 3
    assert [(r.row_id, r.rejected) for r in rejected.collect()] == [(99, "unknown row")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_no_folder_is_made_up():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_dashboard_reads_the_kept_table_once(spark, tmp_path):
    leads = spark.createDataFrame([("1", "penthouse"), ("1", "nhà"), ("2", "thuê bao")], "id string, nhu_cau_mo_ta string")
    result = run_pipeline(leads, path=str(tmp_path / "final"))
    board = dashboard(result.stored)
    assert tuple(board.kpis.first()) == (5, 2, 2, 1, 80.0)
    assert {tuple(r) for r in board.class_counts.collect()} == {("HOT", 2), ("WARM", 2), ("JUNK", 1)}
    assert [r.n for r in board.class_distribution.collect()] == [2, 2, 1]
    assert {tuple(r) for r in board.score_histogram.collect()} == {(50.0, 2), (10.0, 2), (-50.0, 1)}
    assert result.final.count() == 5
    inline = run_pipeline(leads.where("nhu_cau_mo_ta <> 'nhà'"), inline=True)
    assert inline.final.count() == 2 and result.report is None
