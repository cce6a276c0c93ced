"""One id, one score or one text in a third of all rows and more."""

import pytest
from pyspark.sql import functions as F

from siftline.operators.enrich import enrich_compact, enrich_crowded, match_counts
from siftline.operators.metrics import class_counts, kpis, score_histogram, tally
from siftline.operators.rules import score_leads
from siftline.plans import dashboard, export_result, run_pipeline


@pytest.fixture
def settings(spark):
    """Session settings for one test."""
    changed = []

    def change(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            changed.append((key, spark.conf.get(key, None)))
            spark.conf.set(key, value)

    yield change
    for key, value in changed:
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def hot_leads(spark, n, path):
    """A third of the rows share an id and a text; the others repeat their id once."""
    i = F.col("i")
    table = spark.range(n).withColumnRenamed("id", "i").select(
        F.when(i % 3 == 0, F.lit("hot")).otherwise((i - i % 3 + i % 2).cast("string")).alias("id"),
        F.when(i % 3 == 0, F.lit("biệt thự")).when(i % 5 == 0, F.lit("thuê bao")).otherwise(F.lit("nhà")).alias("nhu_cau_mo_ta"),
    )
    table.repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def expected_total(leads):
    return leads.groupBy("id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]


def test_hot_id_through_the_whole_job(spark, settings, tmp_path):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    leads = hot_leads(spark, 3000, str(tmp_path / "in"))
    result = run_pipeline(leads)
    assert result.stored.count() < 3 * 3000
    total = expected_total(leads)
    assert total > 1_000_000
    board = dashboard(result.stored)
    assert board.kpis.first().total == total
    assert kpis(match_counts(leads, score_leads(leads))).first() == board.kpis.first()
    assert kpis(result.final).first() == board.kpis.first()
    path = str(tmp_path / "out")
    export_result(result.stored, path)
    out = spark.read.parquet(path)
    assert out.count() == total
    sizes = [r["count"] for r in out.groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * total


def test_more_pairs_than_a_bigint_holds(spark):
    """Two rows of 9e18 copies each, and counts per id whose product is too large."""
    big = 9 * 10**18
    counts = spark.createDataFrame([(50.0, "HOT", big), (50.0, "HOT", big), (10.0, "WARM", 1)], "score double, classification string, _copies bigint")
    assert tuple(kpis(counts).first())[:3] == (2 * big + 1, 2 * big, 1)
    assert {(r.classification, int(r.n)) for r in class_counts(counts).collect()} == {("HOT", 2 * big), ("WARM", 1)}
    assert {int(r.n) for r in score_histogram(counts).collect()} == {2 * big, 1}
    assert kpis(tally(counts)).first().total == 2 * big + 1


def hot_scorer():
    """A different reason for every lead, and no ids at all."""

    def make():
        def score(prompt):
            import json

            leads, _ = json.JSONDecoder().raw_decode(prompt, prompt.index("\n[{") + 1)
            return json.dumps([{"id": x.get("id"), "score": 10, "classification": "WARM", "reason": x["nhu_cau_mo_ta"]} for x in leads])

        return score

    return make


def test_model_run_stores_no_pairs(spark):
    """Leads without id match each other; with a reason each, all k * k pairs differ."""
    leads = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("text "), F.col("id")).alias("nhu_cau_mo_ta"), F.col("id").alias("n"),
    )
    result = run_pipeline(leads, hot_scorer(), ["n"], unique_order=True)
    assert result.stored.count() == 300 and result.scores.count() == 300
    assert dashboard(result.counts).kpis.first().total == 100 * 100 * 2 + 100
    assert result.final.count() == 100 * 100 * 2 + 100


def test_crowded_ids_are_joined_in_parts(spark):
    """Ids with many different scores on both sides give the same pairs, in parts."""
    leads = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("n"),
    )
    scored = leads.select("id", (F.col("n") % 7).cast("double").alias("score"), F.lit("HOT").alias("classification"), F.col("n").cast("string").alias("reason")).where("n < 390")
    want = enrich_compact(leads, scored)
    for crowd in (20, 1000):
        got = enrich_crowded(leads, scored, crowd)
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_id_is_split_in_the_join(spark, settings, tmp_path):
    """Where nothing may be broadcast, adaptive execution cuts the hot partition."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    leads = hot_leads(spark, 6000, str(tmp_path / "in")).withColumn("extra", F.expr("uuid()"))
    joined = enrich_compact(leads, score_leads(leads))
    assert joined.agg(F.sum("_copies")).first()[0] == expected_total(leads)
    query = joined._jdf.queryExecution()
    query.executedPlan().executeCollect()
    assert "skew=true" in query.executedPlan().toString()
