"""Model responses, batches and fallbacks with stub scorers."""

import json
import os
import random
import shutil
import sys
import tempfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline.config import Rubric
from siftline.functions import parse_scores, strip_fence
from siftline.operators.model import (
    assign_batches,
    build_requests,
    OtherLeads,
    call_scorer,
    place_in_waves,
    store_requests,
    flatten_scores,
    parse_responses,
    score_with_model,
)
from siftline.operators.rules import score_leads
from siftline.sources import materialize
from siftline.plans import run_pipeline

# Workers cannot import this file; the stubs travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUBRIC = Rubric(head="RATE\n", tail="\nEND")
FENCE = "```"


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def leads(spark):
    texts = ["biệt thự", "thuê bao", "nhà phố"]
    rows = [(str(i), texts[i % 3], i) for i in range(45)]
    return spark.createDataFrame(rows, "id string, nhu_cau_mo_ta string, n int").repartition(3)


def answering(reply, log=None):
    """Scorer factory. ``reply`` maps the list of leads in a prompt to a response text."""

    def make():
        def score(prompt):
            if log:
                tempfile.mkstemp(dir=log)
            return reply(json.loads(prompt[len("RATE\n"):-len("\nEND")]))

        return score

    return make


def good(batch):
    return json.dumps([{"id": x["id"], "score": 50, "classification": "HOT", "reason": "m" + x["id"]} for x in batch])


def run(leads, make, **more):
    return score_with_model(leads, make, ["n"], rubric=RUBRIC, unique=True, **more)


@pytest.mark.parametrize(
    "response, text, ids",
    [
        (f'\n {FENCE}json\n[{{"id": 2, "score": "10"}}]\n{FENCE} \n', '[{"id": 2, "score": "10"}]', ["2"]),
        (f"before {FENCE}\n[]\n{FENCE} after", "[]", []),
        ('  [{"id":"a"}]\n', '[{"id":"a"}]', ["a"]),
        (f'{FENCE}x{FENCE}json [{{"id":"b"}}] {FENCE}', '[{"id":"b"}]', ["b"]),
        (f"{FENCE}json\n[]", "[]", []),
        ("junk", "junk", None),
        ('{"id":"1"}', '{"id":"1"}', None),
        ('[{"id":"1"}] and more', '[{"id":"1"}] and more', None),
        ('[{"id":"1"}],"x":1', '[{"id":"1"}],"x":1', None),
        ("[1, 2]", "[1, 2]", None),
        ('[{"id":"1"}, null]', '[{"id":"1"}, null]', None),
        ("null", "null", None),
        ('"text"', '"text"', None),
        ("", "", None),
        (FENCE, "", None),
        (None, None, None),
        ('[{"id":"1","confidence":{"a":[1]}}]', '[{"id":"1","confidence":{"a":[1]}}]', ["1"]),
        (" [] ", "[]", []),
    ],
)
def test_strip_and_parse(spark, response, text, ids):
    df = spark.createDataFrame([(response,)], "r string").select(strip_fence(F.col("r")).alias("t"))
    assert df.first().t == text
    records = df.select(parse_scores(F.col("t")).alias("x")).first().x
    assert (records if records is None else [r.id for r in records]) == ids


def test_requests(leads):
    requests = build_requests(assign_batches(leads, ["n"], unique=True), RUBRIC).orderBy("batch_id").collect()
    assert [(r.batch_id, r.n_leads) for r in requests] == [(0, 20), (1, 20), (2, 5)]
    listed = [x for r in requests for x in json.loads(r.payload)]
    assert [x["id"] for x in listed] == [str(i) for i in range(45)]
    assert listed[0] == {"id": "0", "nhu_cau_mo_ta": "biệt thự"}
    assert requests[2].prompt == "RATE\n" + requests[2].payload + "\nEND"
    assert "biệt thự" in requests[0].payload


def test_good_scorer_is_asked_once_per_batch(leads, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    scored, report = run(leads, answering(good, str(log)))
    for _ in range(2):
        assert table(scored) == sorted(((str(i), 50.0, "HOT", f"m{i}") for i in range(45)), key=str)
        assert table(report) == [(0, 20, "ok", None), (1, 20, "ok", None), (2, 5, "ok", None)]
    assert len(list(log.iterdir())) == 3


def test_failed_batches_use_the_rules(leads):
    def reply(batch):
        if batch[0]["id"] == "0":
            raise RuntimeError("quota")
        if batch[0]["id"] == "20":
            return '{"id": "20"}'
        return good(batch)

    scored, report = run(leads, answering(reply))
    by_rules = [r for r in table(score_leads(leads)) if int(r[0]) < 40]
    assert table(scored) == sorted([*by_rules, *((str(i), 50.0, "HOT", f"m{i}") for i in range(40, 45))], key=str)
    assert table(report) == [
        (0, 20, "fallback", "RuntimeError: quota"),
        (1, 20, "fallback", "the response is not a JSON list of objects"),
        (2, 5, "ok", None),
    ]


def test_response_that_is_no_text(leads):
    scored, report = run(leads, answering(lambda batch: None))
    assert table(scored) == table(score_leads(leads))
    assert {r[2] for r in table(report)} == {"fallback"}


def test_values_are_taken_as_they_come(leads):
    def reply(batch):
        return json.dumps([
            {"id": 1, "score": "7", "classification": "Hot", "confidence": 1},
            {"id": "1", "score": "bad", "reason": "x"},
            {"id": 99, "score": 50},
        ])

    scored, _ = run(leads.where("n < 3"), answering(reply))
    assert table(scored) == sorted([("1", 7.0, "Hot", None), ("1", None, None, "x"), ("99", 50.0, None, None)], key=str)
    result = run_pipeline(leads.where("n < 3"), answering(reply), ["n"], True, rubric=RUBRIC)
    final = [(r.id, r.score, r.classification) for r in result.final.collect()]
    assert sorted(final, key=str) == sorted(
        [("0", None, None), ("1", 7.0, "Hot"), ("1", None, None), ("2", None, None)], key=str
    )


def test_no_usable_answer_means_rules_for_all(leads):
    for text in ("[]", '[{"score": 1}]'):
        scored, report = run(leads, answering(lambda batch, text=text: text))
        assert table(scored) == table(score_leads(leads))
        assert {r[2] for r in table(report)} == {"ok"}


def test_no_scorer_or_broken_setup_means_rules_for_all(leads):
    def broken():
        raise ConnectionError("no key")

    for make in (None, broken):
        scored, report = run(leads, make)
        assert table(scored) == table(score_leads(leads))
        assert report.columns == ["batch_id", "n_leads", "status", "error"]
        assert table(report) == ([(None, None, "fallback", "ConnectionError: no key")] if make else [])


def test_setup_that_fails_in_tasks_only(leads):
    driver = os.getpid()

    def make():
        if os.getpid() != driver:
            raise ConnectionError("worker")
        return lambda prompt: "[]"

    scored, report = run(leads, make)
    assert table(scored) == table(score_leads(leads))
    assert {r[3] for r in table(report)} == {"ConnectionError: worker"}


def test_concurrency_sets_the_number_of_tasks(spark, leads, tmp_path):
    requests = materialize(build_requests(assign_batches(leads, ["n"], 1, unique=True), RUBRIC))
    path = str(tmp_path / "responses")
    responses = call_scorer(requests, answering(good), path, concurrency=2)
    assert len(list((tmp_path / "responses").glob("**/part-*.parquet"))) <= 2
    assert responses.count() == 45 and spark.read.parquet(path).count() == 45
    assert responses.where("size(records) <> 1").isEmpty()


def test_a_run_that_died_is_taken_up(spark, leads, tmp_path):
    """The job dies at the thirtieth batch; the next run asks only for those without an answer."""
    log = tmp_path / "asked"
    log.mkdir()

    def make(fatal):
        def make_scorer():
            def score(prompt):
                start = prompt.index("[{")
                batch, _ = json.JSONDecoder().raw_decode(prompt, start)
                (log / f"{batch[0]['id']}-{fatal}").touch()
                if fatal and batch[0]["id"] == "30":
                    os._exit(1)
                return good(batch)

            return score

        return make_scorer

    requests = materialize(build_requests(assign_batches(leads, ["n"], 1, unique=True), RUBRIC))
    path = str(tmp_path / "responses")
    with pytest.raises(Exception):
        call_scorer(requests, make(True), path, 2, wave=10)
    done = {r.batch_id for r in spark.read.parquet(path).collect()}
    assert done == set(range(30))
    assert call_scorer(requests, make(False), path, 2, wave=10).count() == 45
    asked = {f.name.split("-")[0] for f in log.iterdir() if f.name.endswith("False")}
    assert asked == {str(i) for i in range(30, 45)}


def test_pipeline_without_ids(spark, leads, tmp_path):
    path = str(tmp_path / "leads")
    leads.orderBy("n").drop("id").write.parquet(path)
    stored = spark.read.parquet(path)
    for order in (None, ["n"]):
        got = run_pipeline(stored, answering(good), order, True, rubric=RUBRIC)
        assert got.final.where("cast(id as int) <> n + 1 or reason <> concat('m', id)").isEmpty()
        assert got.final.count() == 45
        rules = run_pipeline(stored, None, order, True)
        assert rules.report is None and rules.final.where("cast(id as int) <> n + 1").isEmpty()


def test_null_ids_reach_the_fallback(spark):
    leads = spark.createDataFrame([(None, "biệt thự", 1), (None, "thuê bao", 2)], "id string, nhu_cau_mo_ta string, n int")
    result = run_pipeline(leads, answering(lambda batch: "no"), ["n"], True, rubric=RUBRIC)
    assert result.final.count() == 4


def test_responses_are_parsed_once(spark):
    df = spark.range(3).select(F.col("id").alias("batch_id"), F.lit("[]").alias("response"))
    df = parse_responses(df.withColumn("response", F.concat("response", F.col("batch_id").cast("string"))))
    plan = flatten_scores(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # once with and once without line breaks in strings


def test_strip_equals_python(spark):
    texts = [w + "x" + w for w in (" ", " \n", "\x1c\t", "　 ", "​", "")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip_fence(F.col("t"))).collect()] == [t.strip() for t in texts]


def readable(text):
    """Python's reading of a response: the ids of a list of objects, or None."""
    for mark in (FENCE + "json", FENCE):
        _, found, rest = text.partition(mark)
        if found:
            text = rest.partition(FENCE)[0]
            break
    try:
        records = json.loads(text.strip())
    except ValueError:
        return None
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        return None
    return [r.get("id") for r in records]


def test_random_responses_equal_python(spark):
    rng = random.Random(11)
    pieces = [
        "[", "]", "{", "}", ",", ":", '"id"', '"score"', '"a"', "1", "-50", "2.5", "1e3", "01", "true", "null", "NaN", "-Infinity", '"tỷ"', '{"id":"1","id":"4"}',
        " ", "\n", "```", "```json", "'id'", '"x\\"y"', '"x\ny"', "\\", "// c", '[{"id":"1"}]', '{"id":"2","score":10}', '{"id":"3"}',
    ]
    base = '[{"id":"1","score":50,"classification":"HOT","reason":"a [b] {c}"},{"id":"2","score":"10"}]'
    texts = []
    for _ in range(3000):
        if rng.random() < 0.5:
            texts.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))))
        else:
            at = rng.randint(0, len(base))
            texts.append(base[:at] + rng.choice(pieces + [""]) + base[at + rng.randint(0, 2):])
    texts.append(base)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch_id int, response string")
    got = {r.batch_id: r.records for r in parse_responses(df).collect()}
    valid = 0
    for i, text in enumerate(texts):
        want = readable(text)
        if want is None:
            assert got[i] is None, text
            continue
        valid += 1
        assert got[i] is not None, text
        plain = [x for x in want if x is None or isinstance(x, str)]
        assert [r.id for r in got[i]][: len(plain)] == plain or len(plain) < len(want), text
    assert valid > 100


def tied(spark, tmp_path, n=400):
    """Leads of one city, so that their order is a matter of ties."""
    path = str(tmp_path / "tied")
    table = spark.range(n).select(F.col("id").cast("string"), F.lit("hn").alias("city"), F.concat(F.lit("need "), "id").alias("nhu_cau_mo_ta"))
    table.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("ids", [True, False])
def test_a_resumed_run_scores_every_lead_once(spark, tmp_path, ids):
    leads = tied(spark, tmp_path)
    leads = leads if ids else leads.drop("id")
    folder = str(tmp_path / "run")
    shown = run_pipeline(leads, answering(good), ["city"], rubric=RUBRIC, responses=folder).final
    first = {(r.id, r.nhu_cau_mo_ta, r.reason) for r in shown.collect()}
    # As if the run had died: a copy with the answers of some batches only.
    half = str(tmp_path / "half")
    for part in ("manifest", "requests", "leads"):
        if (tmp_path / "run" / part).exists():
            shutil.copytree(f"{folder}/{part}", f"{half}/{part}")
    answers = spark.read.parquet(f"{folder}/answers")
    answers.where("batch_id % 3 > 0").write.partitionBy("wave").parquet(f"{half}/answers")
    result = run_pipeline(leads, answering(good), ["city"], rubric=RUBRIC, responses=half)
    assert {(r.id, r.nhu_cau_mo_ta, r.reason) for r in result.final.collect()} == first
    assert result.final.count() == 400 and result.final.where("reason is null").isEmpty()
    assert result.report.count() == 20 and result.scores.groupBy("id").count().where("count > 1").isEmpty()


def test_answers_of_other_leads_are_refused(spark, tmp_path):
    leads, folder = tied(spark, tmp_path), str(tmp_path / "run")
    run_pipeline(leads, answering(good), ["city"], rubric=RUBRIC, responses=folder)
    with pytest.raises(OtherLeads):
        run_pipeline(leads.where("id <> '7'"), answering(good), ["city"], rubric=RUBRIC, responses=folder)
    with pytest.raises(OtherLeads):
        run_pipeline(leads, answering(good), ["city"], rubric=RUBRIC, batch_size=7, responses=folder)
    requests = build_requests(assign_batches(leads, ["city"], 5), RUBRIC)
    with pytest.raises(OtherLeads):
        call_scorer(materialize(requests), answering(good), f"{folder}/answers")


def test_a_wave_reads_its_own_files(spark, tmp_path):
    leads = tied(spark, tmp_path)
    batches = place_in_waves(assign_batches(leads, ["city"], 2), wave=50, lanes=2)
    requests = build_requests(batches, RUBRIC, ("wave", "lane"))
    assert requests._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    stored = store_requests(requests, str(tmp_path / "requests"))
    assert sorted(x.name for x in (tmp_path / "requests").glob("wave=*")) == [f"wave={k}" for k in range(4)]
    assert len(list((tmp_path / "requests").glob("wave=*/*.parquet"))) <= 8
    one = stored.where("wave = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in plan and "Batched: true" in plan
    files = {x.rsplit("/", 2)[1] for x in one.inputFiles()}
    assert one.count() == 50 and one.agg(F.min("batch_id")).first()[0] == 100
    assert {r[0].rsplit("/", 2)[1] for r in one.select("_metadata.file_path").distinct().collect()} == {"wave=2"}, files


def test_ordinals_that_no_batch_can_have(spark):
    rows = [(str(k), "need", k + 1) for k in range(5)]
    schema = "id string, nhu_cau_mo_ta string, ordinal bigint"
    for bad in (None, 3):
        leads = spark.createDataFrame([*rows, ("x", "need", bad)], schema)
        with pytest.raises(Exception, match="ordinal"):
            score_with_model(leads, answering(good), rubric=RUBRIC)
    far = spark.createDataFrame([*rows, ("x", "need", 10**15)], schema)
    scored, report = score_with_model(far, answering(good), rubric=RUBRIC)
    assert scored.count() == 6 and report.count() == 2
