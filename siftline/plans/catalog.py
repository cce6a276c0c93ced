"""Named queries over the test tables, one or more per operator.

Leads are made from ``documents`` (ids occur once) and ``conversations`` (ids repeat), with
phrase lists that occur in them. Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import (
    CLASS,
    DISTRIBUTION_HEADERS,
    HISTOGRAM_HEADERS,
    ID,
    NAME,
    NEED,
    PHONE,
    REASON,
    REVIEW_HEADERS,
    SCORE,
    SCORE_COLUMNS,
    RuleBook,
)
from siftline.functions import (
    classify,
    coerce_class,
    coerce_score,
    fill_reason,
    fill_text,
    first_keyword,
    format_rate,
    normalize_text,
    parse_scores,
    reason_text,
    rule_score,
    strip_fence,
)
from siftline.operators.enrich import (
    enrich,
    enrich_compact,
    expand_copies,
    match_counts,
    union_results,
)
from siftline.operators.metrics import (
    class_counts,
    class_distribution,
    display_names,
    kpis,
    score_histogram,
)
from siftline.operators.model import (
    LANE,
    WAVE_NO,
    assign_batches,
    batch_fallback,
    batch_report,
    build_requests,
    call_scorer,
    numbered_requests,
    flatten_scores,
    parse_responses,
    place_in_waves,
    prune_for_model,
    score_with_model,
    store_requests,
    to_json_payload,
)
from siftline.operators.ordering import ensure_id, number_by_file
from siftline.operators.review import (
    ROW_ID,
    apply_review_edits,
    number_for_review,
    repair_for_review,
    review_order,
    validate_edits,
)
from siftline.operators.rules import JUNK_HIT, VIP, add_phrase_hits, score_inline, score_leads
from siftline.plans.triage import (
    Dashboard,
    Result,
    dashboard,
    export_result,
    make_review,
    review_and_export,
    run_pipeline,
)
from siftline.sources import (
    materialize,
    read_handover,
    read_leads,
    require_rows,
)
from siftline.sources.leads import CSV_OPTIONS, CSV_WRITE_OPTIONS
from siftline.sources.store import new_path

VIP_TEST_PHRASES = ("apache", "mit license", "token", "would")
JUNK_TEST_PHRASES = ("@", "free", "all rights reserved", "with the")
RULES = RuleBook(vip_phrases=VIP_TEST_PHRASES, junk_phrases=JUNK_TEST_PHRASES)


# Lead tables


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def document_leads(spark: SparkSession, sf: str) -> DataFrame:
    return read_leads(spark, f"{sf}/documents.parquet").select(
        F.col("doc_id").cast("string").alias(ID),
        F.col("source").alias(NAME),
        F.col("lang").alias(PHONE),
        F.col("text").alias(NEED),
    )


def document_leads_without_id(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias(NAME), F.col("lang").alias(PHONE), F.col("text").alias(NEED)
    )


def conversation_leads(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias(ID),
        F.col("role").alias(NAME),
        F.col("turn").cast("string").alias(PHONE),
        F.col("text").alias(NEED),
    )


def page_leads(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias(ID), F.col("url").alias(NAME), F.col("html").alias(NEED)
    )


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows for some documents only, with a class that is not one of the three."""
    quality, toxic = F.col("quality"), F.col("toxic")
    return _table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias(ID),
        F.when(toxic == 1, -50.0).when(quality == 1, 50.0).otherwise(10.0).alias(SCORE),
        F.when(toxic == 1, "JUNK").when(quality == 1, "HOT").otherwise("Warm").alias(CLASS),
        F.concat(F.lit("label "), quality.cast("string")).alias(REASON),
    )


def dirty_final(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a joined table with missing and unreadable values in every column."""
    doc, size = F.col("doc_id"), F.col("n_chars").cast("string")
    kind = doc % 12
    score = (
        F.when(kind == 0, size)
        .when(kind == 1, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("-"), size, F.lit(".9")))
        .when(kind == 3, F.concat(size, F.lit("e1")))
        .when(kind == 4, F.concat(size, F.lit("d")))
        .when(kind == 5, F.concat(size, F.lit("e400")))
        .when(kind == 6, F.concat(size, F.lit("000000000")))
        .when(kind == 7, F.concat(F.lit("."), size))
        .when(kind == 8, F.lit(""))
        .when(kind == 9, F.lit("nan"))
        .when(kind == 10, F.col("lang"))
    )
    label = (
        F.when(doc % 5 == 0, "HOT").when(doc % 5 == 1, "Hot").when(doc % 5 == 2, "JUNK").when(doc % 5 == 3, "WARM")
    )
    return _table(spark, sf, "documents").select(
        doc.cast("string").alias(ID),
        F.when(doc % 3 != 0, F.col("source")).alias(NAME),
        F.when(doc % 4 != 0, F.col("lang")).alias(PHONE),
        F.when(doc % 7 != 0, F.col("text")).alias(NEED),
        score.alias(SCORE),
        label.alias(CLASS),
        F.when(doc % 6 != 0, F.col("source")).alias(REASON),
    )


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One model response per document, in every shape a model uses."""
    doc = F.col("doc_id")
    record = F.struct(
        doc.cast("string").alias(ID),
        F.col("n_chars").cast("string").alias(SCORE),
        F.col("lang").alias(CLASS),
        F.col("text").alias(REASON),
    )
    listed = F.to_json(F.array(record))
    text = (
        F.when(doc % 6 == 0, F.concat(F.lit("\n ```json\n"), listed, F.lit("\n``` \n")))
        .when(doc % 6 == 1, F.concat(F.lit("Here:\n```\n"), listed, F.lit("\n```\nDone.")))
        .when(doc % 6 == 2, F.concat(F.lit("  "), listed))
        .when(doc % 6 == 3, F.col("text"))
        .when(doc % 6 == 4, F.to_json(record))
        .otherwise(F.concat(listed, F.lit(" and so on")))
    )
    return _table(spark, sf, "documents").select(
        doc.alias("batch_id"), F.lit(1).cast("bigint").alias("n_leads"), text.alias("response")
    )


def length_scorer():
    """A model that gives every lead the length of its need, whatever batch it is in."""

    def make():
        return score

    def score(prompt):
        import json

        leads, _ = json.JSONDecoder().raw_decode(prompt, prompt.index("\n[{") + 1)
        sizes = [(x["id"], len(x["nhu_cau_mo_ta"])) for x in leads]
        return json.dumps([{"id": i, "score": n, "classification": "HOT", "reason": f"len {n}"} for i, n in sizes])

    return make


def stub_scorer():
    """Factory of a scorer that answers by the first lead of a batch: an error, a fenced list, an
    object or a plain list. All nested, so that workers need no copy of this module."""

    def make():
        return score

    def score(prompt):
        import json

        start = prompt.index("\n[{") + 1
        leads, _ = json.JSONDecoder().raw_decode(prompt, start)
        shape = int(leads[0]["id"]) // 20 % 4
        if shape == 0:
            raise RuntimeError("no answer for " + leads[0]["id"])
        records = []
        for lead in leads:
            size = len(lead["nhu_cau_mo_ta"])
            label = "HOT" if size > 500 else "WARM"
            records.append(
                {"id": lead["id"], "score": size, "classification": label, "reason": f"len {size}"}
            )
        text = json.dumps(records[0] if shape == 2 else records, separators=(",", ":"))
        return "```json\n" + text + "\n```" if shape == 1 else text

    return make


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return document_leads_without_id(spark, sf).withColumn(ID, F.col("doc_id").cast("string"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    narrow = prune_for_model(_numbered(spark, sf), "doc_id")
    return build_requests(assign_batches(narrow, ["doc_id"], unique=True))


def _stored_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``_requests``, grouped and written where ``call_scorer`` reads them: once."""
    narrow = prune_for_model(_numbered(spark, sf), "doc_id")
    batches = place_in_waves(assign_batches(narrow, ["doc_id"], unique=True))
    return store_requests(build_requests(batches, by=(WAVE_NO, LANE)), new_path(spark, "requests"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return call_scorer(_stored_requests(spark, sf), stub_scorer())


def _model_result(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return score_with_model(
        _numbered(spark, sf), stub_scorer(), ["doc_id"], RULES, unique=True
    )


def _resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A run over leads whose order has many ties, taken up where every other batch has its answer."""
    leads, path = _numbered(spark, sf), new_path(spark, "resumed")
    requests = numbered_requests(leads, [PHONE], path=path, written=True)
    call_scorer(requests.where(F.col("batch_id") % 2 == 0), length_scorer(), f"{path}/answers")
    return score_with_model(leads, length_scorer(), [PHONE], RULES, path=path)[0]


def _final(spark: SparkSession, sf: str) -> DataFrame:
    leads = document_leads(spark, sf)
    return enrich(leads, score_leads(leads, RULES))


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(document_leads(spark, sf), label_scores(spark, sf))


def _result(spark: SparkSession, sf: str) -> Result:
    return run_pipeline(document_leads(spark, sf), rules=RULES)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return add_phrase_hits(document_leads(spark, sf), RULES)


def review_edits(review: DataFrame) -> DataFrame:
    """Edits of every kind, some of them not allowed, made from the review table itself."""
    row = F.col(ROW_ID)
    case = row % 20
    kind = (
        F.when(row % 10 == 0, "delete").when(row % 10 == 3, "insert").when(row % 10 == 5, "merge")
        .when(row % 10 != 6, "update")
    )
    return (
        review.select(
            F.when(case == 17, -row).otherwise(row).alias(ROW_ID),
            kind.alias("op"),
            F.when((kind == "insert") | (case == 18), F.concat(F.lit("new-"), F.col(ID))).alias(ID),
            F.when(row % 10 == 1, F.upper(F.col(NAME))).when(kind == "insert", F.col(NAME)).alias(NAME),
            F.when(kind == "insert", F.col(NEED)).alias(NEED),
            F.when(row % 10 == 1, "77").when(row % 10 == 4, "1.5").when(kind == "insert", "10")
            .when(case == 7, "50.0").when(case == 8, "1e2").when(case == 9, "9000000000")
            .when(case == 19, "1e19").alias(SCORE),
            F.when(row % 10 == 1, "HOT").when(row % 10 == 2, "Hot").when(kind == "insert", "WARM").alias(CLASS),
            F.when(row % 10 == 1, F.concat(F.lit("seen "), F.col(ID))).alias(REASON),
            F.when(case == 8, F.array(F.lit(PHONE))).alias("cleared"),
        )
        .where(F.col("op").isNotNull())
    )


def _edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    review = make_review(_result(spark, sf).stored)
    valid, rejected = validate_edits(review_edits(review), review)
    return review, valid, rejected


# Queries


def _read_leads_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    document_leads(spark, sf).write.options(**CSV_WRITE_OPTIONS).csv(path)
    return read_leads(spark, path, "csv")


def _row_count(spark: SparkSession, sf: str) -> DataFrame:
    return document_leads(spark, sf).agg(F.count("*").alias("n"))


def _rule_parts(spark: SparkSession, sf: str, name: str, value: Callable[[], Column]) -> DataFrame:
    return _hits(spark, sf).select(ID, value().alias(name))


def _rule_score() -> Column:
    return rule_score(F.col(VIP), F.col(JUNK_HIT), RULES)


def _rate(spark: SparkSession, sf: str) -> DataFrame:
    return kpis(_gaps(spark, sf)).select(
        "potential_rate", format_rate(F.col("potential_rate")).alias("shown")
    )


def _long_dashboard(board: Dashboard) -> DataFrame:
    """All dashboard tables under one another."""
    counts = board.kpis.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("kpi").alias("part"),
                        F.lit(c).alias("label"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for c in board.kpis.columns
                ]
            )
        )
    )

    def part(name: str, table: DataFrame, label: str) -> DataFrame:
        return table.select(
            F.lit(name).alias("part"),
            F.col(label).cast("string").alias("label"),
            F.col("n").cast("double").alias("value"),
        )

    return (
        counts.unionByName(part("class", board.class_counts, CLASS))
        .unionByName(part("distribution", board.class_distribution, "label"))
        .unionByName(
            part("histogram", board.score_histogram.withColumn(SCORE, F.col(SCORE).cast("int")), SCORE)
        )
    )


def _handover(spark: SparkSession, sf: str, format: str) -> DataFrame:
    stored = _result(spark, sf).stored
    path = new_path(spark, "handover")
    export_result(stored, path, format)
    schema = f"{ID} string, {NAME} string, {PHONE} string, {NEED} string, {SCORE} bigint, {CLASS} string, {REASON} string"
    return number_by_file(read_handover(spark, path, schema, format), "place")


def _handover_with_edits(spark: SparkSession, sf: str) -> DataFrame:
    review = make_review(_result(spark, sf).stored)
    path = new_path(spark, "handover")
    review_and_export(review, path, review_edits(review))
    return spark.read.parquet(path)


def _sorted_review(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted table with the place of each row, as it comes out of a written copy."""
    ordered = review_order(_gaps(spark, sf)).select(ID, SCORE, CLASS)
    return number_by_file(materialize(ordered), "place")


def _counted(counts: DataFrame) -> DataFrame:
    """Counts as bigint, which the test tables fit."""
    return counts.withColumns({c: F.col(c).cast("bigint") for c, t in counts.dtypes if t.startswith("decimal")})


def _csv_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as CSV files of different sizes, whose rows end up in document order: numbered in
    ranges, so that names follow the order, as many as the session has shuffle partitions."""
    path = new_path(spark, "csv")
    docs = _table(spark, sf, "documents").select("doc_id", F.col("lang").alias(PHONE), F.col("text").alias(NEED))
    part = F.when(F.col("doc_id") < 3, 0).when(F.col("doc_id") < 150, 1).otherwise(F.col("doc_id"))
    spread = docs.withColumn("part", part).repartitionByRange("part").sortWithinPartitions("doc_id").drop("part")
    spread.write.options(**CSV_WRITE_OPTIONS).csv(path)
    return spark.read.schema(docs.schema).options(**CSV_OPTIONS).csv(path)


def _filtered_leads(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows of several parquet files."""
    path = new_path(spark, "parts")
    docs = _table(spark, sf, "documents").select("doc_id", F.col("lang").alias(PHONE))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return spark.read.parquet(path).where(F.col(PHONE) == "en")


MANY_PHRASES = tuple(f"{a}{b}{c}" for a in "etaoinsh" for b in "etaoinsh" for c in "qzxjkvbp")


def _fanout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    leads = conversation_leads(spark, sf)
    return leads, score_leads(leads, RULES)


def _run_fallback(spark: SparkSession, sf: str) -> DataFrame:
    def broken():
        raise ConnectionError("no model here")

    return score_with_model(_numbered(spark, sf), broken, ["doc_id"], RULES, unique=True)[0]


def _model_final(spark: SparkSession, sf: str) -> DataFrame:
    result = run_pipeline(
        _numbered(spark, sf), stub_scorer(), ["doc_id"], True, rules=RULES
    )
    return result.final.select(ID, *SCORE_COLUMNS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "read_leads": document_leads,
        "read_leads_csv": _read_leads_csv,
        "require_rows": lambda s, d: require_rows(document_leads(s, d)),
        "ensure_id": lambda s, d: ensure_id(document_leads_without_id(s, d), ["doc_id"], True).select(ID, "doc_id", PHONE),
        "ensure_id_csv": lambda s, d: ensure_id(_csv_leads(s, d)).select(ID, "doc_id", PHONE),
        "ensure_id_filtered": lambda s, d: ensure_id(_filtered_leads(s, d)).select(ID, "doc_id", PHONE),
        "assign_batches_csv": lambda s, d: assign_batches(_csv_leads(s, d)).select("doc_id", "batch_id", "pos"),
        "assign_batches_filtered": lambda s, d: assign_batches(_filtered_leads(s, d)).select("doc_id", "batch_id", "pos"),
        "ensure_id_stored_order": lambda s, d: ensure_id(document_leads_without_id(s, d)).select(ID, "doc_id", PHONE),
        "materialize": lambda s, d: materialize(score_inline(document_leads(s, d), RULES)).select(ID, *SCORE_COLUMNS),
        "export_handover": lambda s, d: _handover(s, d, "parquet"),
        "export_handover_csv": lambda s, d: _handover(s, d, "csv"),
        "row_count": _row_count,
        # projections
        "normalize_text": lambda s, d: document_leads(s, d).select(ID, normalize_text(F.col(NEED)).alias("text")),
        "first_keyword": lambda s, d: _hits(s, d).select(ID, F.col(VIP).alias("vip"), F.col(JUNK_HIT).alias("junk")),
        "first_keyword_many": lambda s, d: document_leads(s, d).select(
            ID, first_keyword(normalize_text(F.col(NEED)), MANY_PHRASES).alias("hit")
        ),
        "rule_score": lambda s, d: _rule_parts(s, d, SCORE, _rule_score),
        "classify": lambda s, d: _rule_parts(s, d, CLASS, lambda: classify(_rule_score(), RULES)),
        "reason_text": lambda s, d: _rule_parts(s, d, REASON, lambda: reason_text(F.col(VIP), F.col(JUNK_HIT), RULES)),
        "score_leads": lambda s, d: score_leads(document_leads(s, d), RULES),
        "score_leads_pages": lambda s, d: score_leads(page_leads(s, d), RULES),
        "score_inline": lambda s, d: score_inline(document_leads(s, d), RULES),
        "prune_for_model": lambda s, d: prune_for_model(document_leads(s, d)),
        "to_json_payload": lambda s, d: prune_for_model(document_leads(s, d)).select(
            ID, to_json_payload(F.array(F.struct(ID, NEED))).alias("payload")
        ),
        "strip_fence": lambda s, d: raw_responses(s, d).select("batch_id", strip_fence(F.col("response")).alias("text")),
        "parse_scores": lambda s, d: raw_responses(s, d).select(
            "batch_id", F.size(parse_scores(strip_fence(F.col("response")))).alias("n")
        ),
        "flatten_scores": lambda s, d: flatten_scores(parse_responses(raw_responses(s, d))),
        "fill_text": lambda s, d: dirty_final(s, d).select(ID, *[fill_text(F.col(c)).alias(c) for c in (NAME, PHONE, NEED)]),
        "coerce_score": lambda s, d: dirty_final(s, d).select(ID, coerce_score(F.col(SCORE)).alias(SCORE)),
        "coerce_class": lambda s, d: dirty_final(s, d).select(ID, coerce_class(F.col(CLASS)).alias(CLASS)),
        "fill_reason": lambda s, d: dirty_final(s, d).select(ID, fill_reason(F.col(REASON)).alias(REASON)),
        "repair_for_review": lambda s, d: repair_for_review(dirty_final(s, d)),
        "display_names": lambda s, d: display_names(_counted(score_histogram(_gaps(s, d))), HISTOGRAM_HEADERS),
        "display_names_distribution": lambda s, d: display_names(_counted(class_distribution(kpis(_gaps(s, d)))), DISTRIBUTION_HEADERS),
        "display_names_review": lambda s, d: display_names(repair_for_review(dirty_final(s, d)), REVIEW_HEADERS),
        "format_rate": _rate,
        # join and union
        "enrich": _final,
        "enrich_fanout": lambda s, d: enrich(*_fanout(s, d)),
        "enrich_gaps": _gaps,
        "enrich_compact": lambda s, d: enrich_compact(*_fanout(s, d)).withColumnRenamed("_copies", "copies"),
        "expand_copies": lambda s, d: expand_copies(enrich_compact(*_fanout(s, d))).groupBy(ID).agg(F.count("*").alias("n")),
        "union_results": lambda s, d: union_results(score_leads(document_leads(s, d), RULES), label_scores(s, d)),
        # dashboard
        "class_counts": lambda s, d: _counted(class_counts(_gaps(s, d))),
        "kpis": lambda s, d: _counted(kpis(_final(s, d))),
        "kpis_gaps": lambda s, d: _counted(kpis(_gaps(s, d))),
        "kpis_fanout": lambda s, d: _counted(kpis(match_counts(*_fanout(s, d)))),
        "class_distribution": lambda s, d: _counted(class_distribution(kpis(_gaps(s, d)))),
        "score_histogram": lambda s, d: _counted(score_histogram(_gaps(s, d))),
        "score_histogram_fanout": lambda s, d: _counted(score_histogram(match_counts(*_fanout(s, d)))),
        # review
        "review_order": lambda s, d: number_for_review(_gaps(s, d)),
        "review_order_sorted": _sorted_review,
        "validate_edits": lambda s, d: _edits(s, d)[2].drop("cleared"),
        "validate_edits_valid": lambda s, d: _edits(s, d)[1].drop("cleared"),
        "apply_review_edits": lambda s, d: apply_review_edits(*_edits(s, d)[:2]),
        # model
        "assign_batches": lambda s, d: assign_batches(
            document_leads_without_id(s, d).select("doc_id", PHONE), ["doc_id"], unique=True
        ).select("doc_id", "batch_id", "pos"),
        "build_requests": lambda s, d: _requests(s, d).drop("prompt"),
        "render_prompt": lambda s, d: _requests(s, d).select("batch_id", "prompt"),
        "call_scorer": lambda s, d: _responses(s, d).select("batch_id", "response", "error"),
        "batch_fallback": lambda s, d: batch_fallback(_responses(s, d), RULES),
        "batch_report": lambda s, d: batch_report(_responses(s, d)),
        "run_fallback": _run_fallback,
        "score_with_model": lambda s, d: _model_result(s, d)[0],
        "score_with_model_resumed": _resumed,
        "score_with_model_report": lambda s, d: _model_result(s, d)[1],
        # whole jobs
        "triage_kpis": lambda s, d: _counted(kpis(_result(s, d).stored)),
        "triage_final": lambda s, d: _result(s, d).final,
        "triage_with_model": _model_final,
        "dashboard": lambda s, d: _long_dashboard(dashboard(_result(s, d).stored)),
        "review_and_export": _handover_with_edits,
    }
