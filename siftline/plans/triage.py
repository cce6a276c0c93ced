"""The whole job: read, score, join, keep; then measure; then review and hand over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import (
    BATCH_SIZE,
    COPIES,
    DEFAULT_RUBRIC,
    DEFAULT_RULES,
    ID,
    RESERVED,
    Rubric,
    RuleBook,
)
from siftline.operators.enrich import (
    COPY_NO,
    enrich_crowded,
    expand_copies,
    match_counts,
    score_and_enrich,
)
from siftline.operators.metrics import (
    class_counts,
    class_distribution,
    kpis,
    score_histogram,
    tally,
)
from siftline.operators.model import ScorerFactory, fingerprint, score_with_model
from siftline.operators.ordering import TIE, ORDINAL, ensure_id
from siftline.operators.review import (
    FEW_EDITS,
    REVIEW_PART,
    apply_review_edits,
    edited,
    number_for_review,
    repair_for_review,
    review_parts,
    spread_copies,
    store_review,
    validate_edits,
)
from siftline.operators.rules import reject_score_columns, score_inline
from siftline.sources.handover import arrange, export_handover, export_parts
from siftline.sources.leads import require_rows
from siftline.sources.store import kept_path, materialize, once, scratch


@dataclass(frozen=True)
class Result:
    """What a run keeps.

    With rules, ``stored`` is the written join: one row per lead and different score row, with the
    number of copies. With a model, which may give the leads of one id as many different score
    rows as there are leads, ``stored`` are the leads and ``scores`` the score rows, both
    written; pairs are made only where they are asked for. ``report`` has one row per model batch.
    """

    stored: DataFrame
    report: DataFrame | None = None
    scores: DataFrame | None = None

    @property
    def compact(self) -> DataFrame:
        """The join with the number of copies of each row."""
        return self.stored if self.scores is None else enrich_crowded(self.stored, self.scores)

    @property
    def counts(self) -> DataFrame:
        """What the dashboard needs: rows per score and class, from counts per id."""
        return self.stored if self.scores is None else match_counts(self.stored, self.scores)

    @property
    def final(self) -> DataFrame:
        """Every row of the left join."""
        return expand_copies(self.compact, spread=self.scores is None)


def run_pipeline(
    leads: DataFrame | None,
    make_scorer: ScorerFactory | None = None,
    order_by: list[str] | None = None,
    unique_order: bool = False,
    inline: bool | None = None,
    rules: RuleBook = DEFAULT_RULES,
    rubric: Rubric = DEFAULT_RUBRIC,
    batch_size: int = BATCH_SIZE,
    concurrency: int | None = None,
    path: str | None = None,
    responses: str | None = None,
) -> Result:
    """Score a lead table and keep the result; what it writes on the way is deleted.

    ``responses`` names a folder that keeps what the model was asked and its answers, and the leads as
    they were numbered if they had no ids. A run that finds these there numbers nothing again and asks
    only for the batches that have no answer; leads other than those it was started with are refused.

    ``inline=True`` says that ids are unique: rule scores then need no join, nor the look at the
    id column that finds repeated ids. Numbered ids always are, so a table without ``id`` takes
    that way by itself.
    """
    leads = reject_score_columns(require_rows(leads), RESERVED)
    spark = leads.sparkSession
    numbered = ID not in leads.columns
    with scratch(spark):
        mark = fingerprint(leads) if responses and make_scorer else None
        if numbered and mark:
            whole = leads
            leads = once(spark, f"{responses}/leads", lambda: ensure_id(whole, order_by, unique_order))
        else:
            leads = ensure_id(leads, order_by, unique_order)
        path = path or kept_path(spark, "final")
        if make_scorer is None:
            if numbered if inline is None else inline:
                stored = score_inline(leads, rules).withColumn(COPIES, F.lit(1).cast("bigint"))
            else:
                stored = score_and_enrich(leads, rules)
            return Result(materialize(stored, path))
        batched = leads.withColumn(ORDINAL, F.col(ID).cast("bigint")) if numbered else leads
        scored, report = score_with_model(
            batched, make_scorer, order_by, rules, rubric, batch_size, unique_order,
            path=responses, concurrency=concurrency, mark=mark,
        )
        return Result(
            materialize(leads, path),
            materialize(report, kept_path(spark, "report")),
            materialize(scored, kept_path(spark, "scored")),
        )


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    class_counts: DataFrame
    class_distribution: DataFrame
    score_histogram: DataFrame


def dashboard(stored: DataFrame) -> Dashboard:
    """All dashboard tables of the kept result, from one pass over three of its columns."""
    counts = materialize(tally(stored), name="tally")
    row = kpis(counts)
    return Dashboard(row, class_counts(counts), class_distribution(row), score_histogram(counts))


def make_review(stored: DataFrame, path: str | None = None) -> DataFrame:
    """The written review table: numbered, repaired and in review order. This is what reviewers see
    and what their edits refer to; it is made once. ``stored`` is the kept result, as written."""
    spark = stored.sparkSession
    with scratch(spark):
        review = repair_for_review(number_for_review(stored, written=True, part=REVIEW_PART))
        return store_review(review, path or kept_path(spark, "review"))


def export_result(stored: DataFrame, path: str, format: str = "parquet") -> str:
    """The hand-over without a review: from the kept result to the files in one range shuffle."""
    full, order = spread_copies(stored, written=True)
    return export_handover(repair_for_review(arrange(full, order)).drop(TIE, COPY_NO), path, format, arranged=True)


def review_and_export(
    review: DataFrame, path: str, edits: DataFrame | None = None, format: str = "parquet"
) -> DataFrame | None:
    """Apply the edits to the written review table and write the hand-over, in the order of the
    review. Returns the rejected edits, written, if any edits were given.

    Rows keep the numbers that the reviewers saw, wherever the table lies now. The review table lies in
    ranges of numbers, so its rows are read and written where they are: edits go to them, and only
    inserted rows are put in order. Other tables, and very many edits, take a range shuffle.
    """
    spark = review.sparkSession
    parts = review_parts(review)
    with scratch(spark):
        if edits is not None:
            valid, rejected = validate_edits(edits, review)
        if parts is None:
            export_handover(review if edits is None else apply_review_edits(review, valid), path, format)
        else:
            rows, ranges = parts
            last = ranges.agg(F.max(REVIEW_PART)).first()[0]
            kept, new, n = (rows, rows.limit(0), 0) if edits is None else edited(rows, valid)
            if n <= FEW_EDITS:
                export_parts(kept, new, REVIEW_PART, (last if last is not None else -1) + 1, path, format)
            else:
                export_handover(kept.unionByName(new).drop(REVIEW_PART), path, format)
        return None if edits is None else materialize(rejected, kept_path(spark, "rejected"))
