"""Scoring leads in batches with a model the caller supplies.

requests  -> one row per batch of consecutive leads, with the prompt, stored by wave
responses -> one row per batch, parsed and written before anything reads it
scores    -> projections of the written responses; failed batches are scored by the rules

After the model has answered nothing is shuffled or joined: a response row carries the leads of
its batch, so the fallback needs no second look at the lead table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.config import (
    BATCH_SIZE,
    CLASS,
    DEFAULT_RUBRIC,
    DEFAULT_RULES,
    ID,
    LEAD_COLUMNS,
    NEED,
    REASON,
    SCORE,
    Rubric,
    RuleBook,
)
from siftline.functions.repair import parse_number
from siftline.functions.responses import parse_scores, strip_fence
from siftline.operators.enrich import union_results
from siftline.operators.ordering import BATCH_ID, ORDINAL, POSITION, assign_batches
from siftline.operators.rules import score_leads
from siftline.sources.store import materialize, new_path

# Asks a model: prompt in, response text out. Any exception makes its batch a failed one.
Scorer = Callable[[str], str]
# Sets a scorer up. Called once on the driver as a check and once in every task.
ScorerFactory = Callable[[], Scorer]

LEADS_SCHEMA = f"array<struct<{ID}:string,{NEED}:string>>"
BAD_RESPONSE = "the response is not a JSON list of objects"

# Model calls at a time unless the caller says otherwise; it does not follow the size of the table.
CONCURRENCY = 8
# Requests whose answers are written together. A run that dies loses the answers of one wave at most.
WAVE = 2_000

REQUEST_COLUMNS = (BATCH_ID, "n_leads", "payload", "prompt")
WAVE_NO = "wave"
LANE = "lane"
# What stands before and after the payload in a prompt, and what tells payloads apart.
BEFORE = "_before"
AFTER = "_after"
PRINT = "_print"

OK = "ok"
FALLBACK = "fallback"


class OtherLeads(ValueError):
    """Answers of an earlier run that are not of these leads."""


def prune_for_model(leads: DataFrame, *keep: str) -> DataFrame:
    """The two columns a model may see, as strings, and the named helper columns."""
    need = F.col(NEED) if NEED in leads.columns else F.lit(None)
    return leads.select(
        F.col(ID).cast("string").alias(ID),
        F.coalesce(need.cast("string"), F.lit("")).alias(NEED),
        *keep,
    )


def to_json_payload(leads: Column) -> Column:
    """An array of lead structs as JSON text, non-ASCII characters kept."""
    return F.to_json(leads)


def render_prompt(payload: Column, rubric: Rubric = DEFAULT_RUBRIC) -> Column:
    return F.concat(F.lit(rubric.head), payload, F.lit(rubric.tail))


def build_requests(
    batches: DataFrame, rubric: Rubric = DEFAULT_RUBRIC, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per batch: batch_id, n_leads, payload, prompt, and the columns ``by`` that the rows of
    a batch share. A batch is a bounded group; two leads at one place of it are an error.

    The rows move once, whole: a list has nothing to combine before the shuffle.
    """
    place = F.struct(POSITION, ID, NEED)
    grouped = batches.groupBy(BATCH_ID, *by).agg(
        F.count("*").alias("n_leads"),
        F.sort_array(F.collect_list(place)).alias("_leads"),
    )
    twice = F.size(F.array_distinct(f"_leads.{POSITION}")) < F.size("_leads")
    checked = F.when(twice, F.raise_error(F.lit("two leads have one ordinal"))).otherwise(F.col("_leads"))
    leads = F.transform(checked, lambda x: F.struct(x[ID].alias(ID), x[NEED].alias(NEED)))
    return grouped.select(
        BATCH_ID, "n_leads", to_json_payload(leads).alias("payload"), *by
    ).withColumn("prompt", render_prompt(F.col("payload"), rubric))


def _ask(make_scorer: ScorerFactory):
    """Column function that asks the model; errors are data. Nested, so that workers need no
    copy of this module."""

    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, broken = None, None
        try:
            scorer = make_scorer()
        except Exception as e:
            broken = f"{type(e).__name__}: {e}"
        for batch in prompts:
            answers = []
            for prompt in batch:
                if broken:
                    answers.append((None, broken))
                    continue
                try:
                    answer = scorer(prompt)
                    if not isinstance(answer, str):
                        raise TypeError("the scorer gave no text")
                    answers.append((answer, None))
                except Exception as e:
                    answers.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(answers, columns=["response", "error"], dtype="object")

    # Non-deterministic: Catalyst may then neither repeat nor reorder the calls.
    return F.pandas_udf(ask, "response string, error string").asNondeterministic()


def ask_model(requests: DataFrame, make_scorer: ScorerFactory) -> DataFrame:
    """Requests with the model's response or the error. Only the prompt goes through Python.
    Every action on this frame asks again, so it is written before anyone reads it."""
    wave = [WAVE_NO] if WAVE_NO in requests.columns else []
    return requests.withColumn("_answer", _ask(make_scorer)("prompt")).select(
        BATCH_ID, "n_leads", "payload", *wave, "_answer.response", "_answer.error"
    )


def store_requests(
    requests: DataFrame, path: str, wave: int = WAVE, lanes: int = CONCURRENCY
) -> DataFrame:
    """``requests`` (or batches, see ``place_in_waves``) written in one folder a wave of ``wave``
    consecutive batches, so that asking a wave reads its own files and no others. The leads in them are
    moved and written once: a prompt is kept without its payload."""
    cut = cut_prompts(requests)
    placed = cut if WAVE_NO in requests.columns else place_in_waves(cut, wave, lanes)
    columns = [BEFORE if c == "prompt" else c for c in REQUEST_COLUMNS]
    stored = materialize(placed.select(*columns, AFTER, WAVE_NO), path, by=(WAVE_NO,), mode="overwrite")
    return whole_prompts(stored).select(*REQUEST_COLUMNS, WAVE_NO)


def cut_prompts(requests: DataFrame) -> DataFrame:
    """``requests`` with what stands before and after the payload in place of the prompt. A prompt that is
    not these parts put together, letter by letter, stays whole: it has nothing after."""
    prompt, payload = F.col("prompt"), F.col("payload")
    at = F.instr(prompt, payload)
    before, after = F.substr(prompt, F.lit(1), at - 1), F.substr(prompt, at + F.length(payload))
    same = F.concat(before, payload, after) == prompt
    return requests.withColumns(
        {BEFORE: F.when(same, before).otherwise(prompt), AFTER: F.when(same, after)}
    ).drop("prompt")


def whole_prompts(requests: DataFrame) -> DataFrame:
    """The reverse of ``cut_prompts``."""
    joined = F.concat(BEFORE, "payload", AFTER)
    return requests.withColumn("prompt", F.when(F.col(AFTER).isNull(), F.col(BEFORE)).otherwise(joined)).drop(
        BEFORE, AFTER
    )


def spread(requests: DataFrame, concurrency: int) -> DataFrame:
    """``requests`` dealt to ``concurrency`` tasks; the leads in them move once."""
    return whole_prompts(cut_prompts(requests).repartition(concurrency, BATCH_ID))


def with_print(table: DataFrame) -> DataFrame:
    """``table`` with the SHA-256 of its payloads, which stands for them where tables are compared."""
    return table.withColumn(PRINT, F.sha2("payload", 256))


def unanswered(requests: DataFrame, prints: DataFrame) -> DataFrame:
    """The requests of a wave that have no answer in ``prints``. These are as many as the wave has
    batches at most, so they go to the requests, which stay where they are."""
    return with_print(requests).join(F.broadcast(prints), [BATCH_ID, PRINT], "left_anti").drop(PRINT)


def place_in_waves(table: DataFrame, wave: int = WAVE, lanes: int = CONCURRENCY) -> DataFrame:
    """``table`` with the ``wave`` of each batch, dealt so that a wave is ``lanes`` files at most. Batches
    dealt so are grouped without another shuffle."""
    number = F.expr(f"{BATCH_ID} div {wave}")
    return table.withColumns({WAVE_NO: number, LANE: F.pmod(BATCH_ID, F.lit(lanes))}).repartition(WAVE_NO, LANE)


def call_scorer(
    requests: DataFrame,
    make_scorer: ScorerFactory,
    path: str | None = None,
    concurrency: int = CONCURRENCY,
    wave: int = WAVE,
) -> DataFrame:
    """Ask the model once per request and write the answers: batch_id, n_leads, payload, response,
    error, and the parsed ``records``.

    ``requests`` is a written table; one that is not stored by wave yet is stored so first. Waves
    that have batches are asked one after the other, ``concurrency`` calls at a time; each wave is
    written before the next one starts. Requests that ``path`` has an answer of are not asked
    again, so a run that died is taken up where it stopped by naming its path. Answers there of other
    requests raise ``OtherLeads``.
    """
    spark = requests.sparkSession
    path = path or new_path(spark, "responses")
    if WAVE_NO not in requests.columns:
        requests = store_requests(requests, new_path(spark, "requests"), wave, concurrency)
    shape = parse_responses(ask_model(requests, make_scorer)).schema
    done = _stored(spark, path, shape)
    # One number a wave, from the names of the folders.
    waves = sorted(r[WAVE_NO] for r in requests.select(WAVE_NO).distinct().collect())
    answered = {r[WAVE_NO] for r in done.select(WAVE_NO).distinct().collect()} if done else set()
    if answered - set(waves):
        raise OtherLeads(f"{path} has answers of other requests")
    for number in waves:
        part = requests.where(F.col(WAVE_NO) == number)
        if number in answered:
            there = with_print(done.where(F.col(WAVE_NO) == number)).select(BATCH_ID, PRINT).distinct()
            if not there.join(with_print(part).select(BATCH_ID, PRINT), [BATCH_ID, PRINT], "left_anti").isEmpty():
                raise OtherLeads(f"{path} has answers of other requests")
            part = unanswered(part, there)
            if part.isEmpty():
                continue
        asked = parse_responses(ask_model(spread(part, concurrency), make_scorer))
        asked.write.mode("append").partitionBy(WAVE_NO).parquet(path)
    if not waves:
        parse_responses(ask_model(requests, make_scorer)).write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path).drop(WAVE_NO)


def _stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at ``path``, if there is one."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with their score ``records``, NULL for a failed batch."""
    text = responses.withColumn("_text", strip_fence(F.col("response")))
    return text.withColumn("records", parse_scores(F.col("_text"))).drop("_text")


def flatten_scores(parsed: DataFrame) -> DataFrame:
    """One score row per record; failed batches give none. Scores and classes are taken as
    they come.

    For a plain explode Catalyst adds a filter on the size of the array, and so would parse every
    response a second time; the outer form has none.
    """
    records = parsed.select(F.posexplode_outer("records").alias("_pos", "_record"))
    return (
        records.where(F.col("_pos").isNotNull())
        .select("_record.*")
        .select(ID, parse_number(F.col(SCORE)).alias(SCORE), CLASS, REASON)
    )


def batch_fallback(parsed: DataFrame, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """Rule scores for every lead of the failed batches."""
    failed = parsed.where(F.col("records").isNull())
    leads = failed.select(F.inline_outer(F.from_json("payload", LEADS_SCHEMA)))
    return score_leads(leads, rules)


def batch_report(parsed: DataFrame) -> DataFrame:
    """One row per batch: batch_id, n_leads, status, error."""
    failed = F.col("records").isNull()
    return parsed.select(
        BATCH_ID,
        "n_leads",
        F.when(failed, F.lit(FALLBACK)).otherwise(F.lit(OK)).alias("status"),
        F.when(failed, F.coalesce("error", F.lit(BAD_RESPONSE))).alias("error"),
    )


EMPTY_REPORT = f"{BATCH_ID} bigint, n_leads bigint, status string, error string"


def run_fallback(
    leads: DataFrame, rules: RuleBook = DEFAULT_RULES, error: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rule scores for all leads; the report is empty, or tells why no model was asked in a row
    without a batch."""
    rows = [(None, None, FALLBACK, error)] if error else []
    return score_leads(leads, rules), leads.sparkSession.createDataFrame(rows, EMPTY_REPORT)


def fingerprint(leads: DataFrame) -> tuple[int, str]:
    """Number of leads, and a sum of hashes of what they say, whatever their order."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in LEAD_COLUMNS if c in leads.columns]
    total = F.sum(F.xxhash64(*said, F.lit(0)).cast("decimal(20,0)"))
    row = leads.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("string").alias("mark")).first()
    return row["n"], row["mark"]


def numbered_requests(
    leads: DataFrame,
    order_by: list[str] | None,
    rubric: Rubric = DEFAULT_RUBRIC,
    batch_size: int = BATCH_SIZE,
    unique: bool = False,
    path: str | None = None,
    concurrency: int = CONCURRENCY,
    mark: tuple[int, str] | None = None,
    written: bool = False,
) -> DataFrame:
    """The requests of ``leads``, stored by wave. ``written`` says that ``leads`` are rows of stored files
    as they stand, so that ties need no copy of them (see ``number_rows``).

    With a ``path`` they are kept there and a manifest with them: which lead is in which batch at
    which place, how many leads there are and what they say. A run that finds a manifest takes these
    requests and numbers nothing, so that answers stay with the leads they were given for,
    even if ties of ``order_by`` would now be cut otherwise. Leads, rubric or batch size other than
    those of the manifest raise ``OtherLeads``.
    """
    spark = leads.sparkSession
    manifest = None
    if path:
        n, said = mark or fingerprint(leads)
        asked = hashlib.sha256(f"{batch_size}\0{rubric.head}\0{rubric.tail}".encode()).hexdigest()
        manifest = (n, said, asked)
        kept = _stored(spark, f"{path}/manifest")
        if kept is not None:
            if tuple(kept.first()) != manifest:
                raise OtherLeads(f"{path} belongs to other leads, another rubric or batch size")
            requests = _stored(spark, f"{path}/requests", _stored_schema())
            requests = requests if requests is not None else spark.createDataFrame([], _stored_schema())
            # Folders of runs before prompts were cut have them whole.
            old = requests.withColumn(BEFORE, F.coalesce(BEFORE, "prompt")).drop("prompt")
            return whole_prompts(old).select(*REQUEST_COLUMNS, WAVE_NO)
    # Only what the model sees is numbered and shuffled, not the whole lead table.
    order = [ORDINAL] if ORDINAL in leads.columns else order_by or []
    narrow = prune_for_model(leads, *[c for c in order if c not in (ID, NEED)])
    batches = place_in_waves(assign_batches(narrow, order_by, batch_size, unique, written), lanes=concurrency)
    folder = f"{path}/requests" if path else new_path(spark, "requests")
    requests = store_requests(build_requests(batches, rubric, (WAVE_NO, LANE)), folder)
    if path:
        one = spark.createDataFrame([manifest], "n bigint, said string, asked string")
        one.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return requests


def _stored_schema() -> StructType:
    return StructType.fromDDL(
        f"{BATCH_ID} bigint, n_leads bigint, payload string, prompt string, {BEFORE} string, {AFTER} string, {WAVE_NO} bigint"
    )


def score_with_model(
    leads: DataFrame,
    make_scorer: ScorerFactory | None,
    order_by: list[str] | None = None,
    rules: RuleBook = DEFAULT_RULES,
    rubric: Rubric = DEFAULT_RUBRIC,
    batch_size: int = BATCH_SIZE,
    unique: bool = False,
    path: str | None = None,
    concurrency: int | None = None,
    mark: tuple[int, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Score rows from the model and a report per batch. ``concurrency`` is the number of model
    calls at a time. ``path`` names a folder that keeps requests, manifest and answers, so that a
    run that died can be taken up (see ``numbered_requests``); ``mark`` is the ``fingerprint`` of the
    leads it was started with, if these have been numbered since.

    Rules score a failed batch. They score all leads when there is no scorer, when it cannot be
    set up, or when no response names any lead.
    """
    if make_scorer is None:
        return run_fallback(leads, rules)
    try:
        make_scorer()
    except Exception as e:
        return run_fallback(leads, rules, f"{type(e).__name__}: {e}")

    calls = concurrency or CONCURRENCY
    requests = numbered_requests(leads, order_by, rubric, batch_size, unique, path, calls, mark)
    # Answers and what they parse to are written together: each is asked and parsed once.
    parsed = call_scorer(requests, make_scorer, f"{path}/answers" if path else None, calls)
    scored = union_results(flatten_scores(parsed), batch_fallback(parsed, rules))
    report = batch_report(parsed)
    if scored.where(F.col(ID).isNotNull()).isEmpty():
        return score_leads(leads, rules), report
    return scored, report
