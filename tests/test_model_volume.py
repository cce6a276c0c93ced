"""How often the texts of the leads are moved and written on their way to the model."""

import json
import os
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline.config import Rubric
from siftline.operators.model import (
    AFTER,
    BEFORE,
    OtherLeads,
    assign_batches,
    build_requests,
    call_scorer,
    cut_prompts,
    numbered_requests,
    score_with_model,
    spread,
    store_requests,
    unanswered,
    whole_prompts,
    with_print,
)
from siftline.plans import catalog
from siftline.sources.store import scratch

# Workers cannot import this file; the stubs travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUBRIC = Rubric(head="RATE\n", tail="\nEND")


def echo(fail=()):
    """A model that gives every lead 1 point; batches whose first lead is in ``fail`` get an error."""

    def make():
        def score(prompt):
            leads = json.loads(prompt[len("RATE\n"):-len("\nEND")])
            if leads[0]["id"] in fail:
                raise RuntimeError("no")
            return json.dumps([{"id": x["id"], "score": 1, "classification": "HOT", "reason": x["nhu_cau_mo_ta"]} for x in leads])

        return score

    return make


@pytest.fixture
def leads(spark, tmp_path):
    need = F.concat(F.lit("tỷ "), F.sha2(F.col("id").cast("string"), 512))
    table = spark.range(400).select(F.col("id").cast("string"), F.lit("hn").alias("sdt"), need.alias("nhu_cau_mo_ta"))
    table.write.parquet(str(tmp_path / "leads"))
    return spark.read.parquet(str(tmp_path / "leads"))


def test_cut_prompts_are_whole_again(spark):
    prompts = [
        ("[1]", "a[1]b"), ("[1]", "[1]"), ("[1]", "a"), ("[1]", "[1][1]"), ("[1]", None), (None, "a"), (None, None),
        ("", "ab"), ("", ""), ("tỷ\U0001f600", "é tỷ\U0001f600 ß"), ("aab", "aaab"), ("[1]longer", "[1]"),
    ]
    rows = [(k, 1, payload, prompt) for k, (payload, prompt) in enumerate(prompts)]
    table = spark.createDataFrame(rows, "batch_id bigint, n_leads bigint, payload string, prompt string")
    broken = spark.sql(  # a payload whose last letter is cut off
        "SELECT 99L AS batch_id, 1L AS n_leads, cast(X'61E1BB' AS string) AS payload, cast(X'2D61E1BB626364' AS string) AS prompt"
    )
    table = table.unionByName(broken)
    want = {r[0]: r[1] for r in table.select("batch_id", F.hex(F.col("prompt").cast("binary"))).collect()}
    for back in (whole_prompts(cut_prompts(table)), spread(table, 3)):
        assert {r[0]: r[1] for r in back.select("batch_id", F.hex(F.col("prompt").cast("binary"))).collect()} == want
        assert set(back.columns) == set(table.columns)


def test_a_prompt_is_stored_without_its_payload(spark, leads, tmp_path):
    requests = build_requests(assign_batches(leads, ["sdt"]), RUBRIC)
    stored = store_requests(requests, str(tmp_path / "requests"))
    assert stored.columns == ["batch_id", "n_leads", "payload", "prompt", "wave"]
    assert stored.where("prompt <> concat('RATE\n', payload, '\nEND')").isEmpty() and stored.count() == 20
    files = spark.read.parquet(str(tmp_path / "requests"))
    assert "prompt" not in files.columns
    assert {tuple(r) for r in files.select(BEFORE, AFTER).distinct().collect()} == {("RATE\n", "\nEND")}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_what_is_asked_moves_without_the_prompt(spark, leads, tmp_path):
    stored = store_requests(build_requests(assign_batches(leads, ["sdt"]), RUBRIC), str(tmp_path / "requests"))
    left = spread(stored, 4)
    moved = left._jdf.queryExecution().optimizedPlan().toString()
    child = moved.split("RepartitionByExpression", 1)[1].splitlines()[1]
    assert "AS _before" in child and "AS prompt" not in child
    assert left.rdd.getNumPartitions() == 4


def test_answers_are_compared_without_moving_requests(spark, leads, tmp_path):
    stored = store_requests(build_requests(assign_batches(leads, ["sdt"]), RUBRIC), str(tmp_path / "requests"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prints = with_print(stored.where("batch_id < 7")).select("batch_id", "_print").distinct()
        left = unanswered(stored, prints)
        assert not [x for x in exchanges(left) if "payload" in x or "prompt" in x]
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.batch_id for r in left.collect()) == list(range(7, 20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("whole", [False, True])
def test_a_run_is_taken_up_from_cut_and_from_whole_prompts(spark, leads, tmp_path, whole):
    """``whole`` is a folder that was written before prompts were stored without their payload."""
    path = str(tmp_path / "run")
    requests = numbered_requests(leads, ["sdt"], RUBRIC, path=path, written=True)
    before = {r.batch_id: (r.payload, r.prompt) for r in requests.collect()}
    if whole:
        old = spark.createDataFrame(requests.collect(), requests.schema)
        old.write.mode("overwrite").partitionBy("wave").parquet(f"{path}/requests")
        requests = spark.read.schema(requests.schema).parquet(f"{path}/requests")
    call_scorer(requests.where("batch_id % 2 = 0"), echo(), f"{path}/answers")
    again = numbered_requests(leads, ["sdt"], RUBRIC, path=path)
    assert {r.batch_id: (r.payload, r.prompt) for r in again.collect()} == before
    scored, report = score_with_model(leads, echo(), ["sdt"], rubric=RUBRIC, path=path)
    assert report.count() == 20 and report.where("status <> 'ok'").isEmpty()
    assert scored.count() == 400 and scored.select("id").distinct().count() == 400
    other = requests.withColumn("payload", F.concat(F.lit(" "), "payload"))
    with pytest.raises(OtherLeads):
        call_scorer(other, echo(), f"{path}/answers")


def test_ties_of_stored_rows_are_numbered_without_a_copy(spark, leads):
    for written, copies in ((True, 0), (False, 1)):
        with scratch(spark) as path:
            placed = assign_batches(leads, ["sdt"], written=written)
            assert sorted((r.batch_id, r.pos) for r in placed.collect()) == [(k // 20, k % 20) for k in range(400)]
            assert sum(x.startswith("siftline-ties") for x in os.listdir(path)) == copies


@pytest.fixture
def documents(spark, tmp_path):
    """200 documents of 5 kB that do not compress."""
    words = [F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f" {k}")), 512) for k in range(40)]
    table = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", *words))
    table = table.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    table.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    return str(tmp_path / "sf")


def written_for(spark, documents, name, look):
    """What ``look`` makes of the query's rows, and the texts written for it, as copies of the input."""
    with scratch(spark) as path:
        seen = look(catalog.queries()[name](spark, documents))
        return seen, parquet_bytes(path) / parquet_bytes(documents)


def parquet_bytes(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_call_scorer_writes_numbered_rows_requests_and_answers(spark, documents):
    rows, copies = written_for(spark, documents, "call_scorer", lambda df: sorted(tuple(r) for r in df.collect()))
    assert [r[0] for r in rows] == list(range(10)) and [bool(r[2]) for r in rows] == [k % 4 == 0 for k in range(10)]
    assert [r[1] is None for r in rows] == [k % 4 == 0 for k in range(10)]
    assert copies < 3.5


def test_batch_fallback_writes_no_more_than_the_calls(spark, documents):
    rows, copies = written_for(spark, documents, "batch_fallback", lambda df: sorted(int(r.id) for r in df.collect()))
    assert rows == [k for k in range(200) if k // 20 % 4 in (0, 2)]
    assert copies < 3.5


def test_batch_report_writes_no_more_than_the_calls(spark, documents):
    rows, copies = written_for(spark, documents, "batch_report", lambda df: sorted(tuple(r)[:3] for r in df.collect()))
    assert rows == [(k, 20, "fallback" if k % 4 in (0, 2) else "ok") for k in range(10)]
    assert copies < 3.5
