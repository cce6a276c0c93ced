"""Joining scores back to the leads.

The join keeps every pair of a lead and a score row with the same id (missing ids match each
other), so an id with k leads and k score rows gives k * k rows. Most of those are copies: rule
scores of one id take few different values. So equal score rows are counted first and joined once
with their number in ``_copies``. That table grows with the leads, holds everything the dashboard
needs, and ``expand_copies`` turns it into the full row-by-row table where one is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import (
    CLASS,
    COPIES,
    DEFAULT_RULES,
    ID,
    REASON,
    SCORE,
    SCORE_COLUMNS,
    RuleBook,
)
from siftline.operators.rules import reject_score_columns, score_inline, score_leads
from siftline.sources.store import fresh, materialize

# Copies are made in blocks, so that a row wanted very often never needs one huge array. A block is
# also the least that is worth moving to another task.
COPY_BLOCK = 64
BLOCK_STEP = 65_536

# An id of more different score rows than this is joined in parts.
CROWD = 1_000

COPY_NO = "_copy"
_BLOCK = "_block"

_SCORED_ID = "_scored_id"
WIDE = "decimal(38,0)"


def distinct_scores(scored: DataFrame) -> DataFrame:
    """Different score rows with the number of times each occurs. Counts map-side first, so an
    id that holds much of the table reaches the shuffle as a few rows per task."""
    return scored.groupBy(ID, *SCORE_COLUMNS).agg(F.count("*").alias(COPIES))


def enrich_compact(leads: DataFrame, scored: DataFrame) -> DataFrame:
    """Left join on ``id``; ``_copies`` says how often each row stands in the full result.

    Leads without a score row stay, with empty score columns. Score rows without a lead are
    dropped. A hot id is large on the lead side only, which adaptive skew handling splits.
    """
    reject_score_columns(leads)
    right = distinct_scores(scored).withColumnRenamed(ID, _SCORED_ID)
    joined = leads.join(right, leads[ID].eqNullSafe(right[_SCORED_ID]), "left")
    return joined.drop(_SCORED_ID).withColumn(COPIES, F.coalesce(F.col(COPIES), F.lit(1)))


def enrich_crowded(leads: DataFrame, scored: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``enrich_compact`` for ids that may have very many different score rows, as a model gives them.

    Such an id is large on both sides, and splitting the leads alone would send all its score rows to
    every part. So its score rows are dealt into parts of about ``crowd``, each of its leads goes
    to all of these, and id and part together are joined: the work of a task stays in proportion to
    the pairs it makes. Other ids are joined as usual.
    """
    reject_score_columns(leads)
    right = materialize(distinct_scores(scored).withColumnRenamed(ID, _SCORED_ID), name="scores")
    crowd_id, n, parts, lead_part, score_part = fresh(leads, "_crowd_id", "_n", "_parts", "_lead_part", "_score_part")
    sizes = right.groupBy(F.col(_SCORED_ID).alias(crowd_id)).agg(F.count("*").alias(n))
    many = sizes.where(F.col(n) > crowd).select(crowd_id, F.expr(f"({n} - 1) div {crowd} + 1").alias(parts))
    many = materialize(many, name="crowded")

    def left_join(table: DataFrame, scores: DataFrame) -> DataFrame:
        joined = table.join(scores, table[ID].eqNullSafe(scores[_SCORED_ID]), "left").drop(_SCORED_ID)
        return joined.withColumn(COPIES, F.coalesce(F.col(COPIES), F.lit(1)))

    if many.isEmpty():
        return left_join(leads, right)
    of_lead = leads[ID].eqNullSafe(many[crowd_id])
    of_score = right[_SCORED_ID].eqNullSafe(many[crowd_id])
    few = left_join(leads.join(many, of_lead, "left_anti"), right.join(many, of_score, "left_anti"))
    part = F.pmod(F.xxhash64(*SCORE_COLUMNS), F.col(parts))
    scores = right.join(many, of_score).withColumn(score_part, part).drop(crowd_id, parts)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    dealt = leads.join(many, of_lead).withColumn(lead_part, every).drop(crowd_id, parts)
    same = dealt[ID].eqNullSafe(scores[_SCORED_ID]) & (dealt[lead_part] == scores[score_part])
    crowded = dealt.join(scores, same).drop(lead_part, score_part, _SCORED_ID)
    return few.unionByName(crowded)


def score_and_enrich(leads: DataFrame, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """``enrich_compact(leads, score_leads(leads))`` without shuffling the lead table where ids
    seldom repeat.

    A lead whose id stands in no other row is joined to its own score only, so that score is put
    beside it in the scan. Repeated ids are found from the id column alone, and only their rows
    are scored for the join. Both tables are written, so that Spark knows their size: it
    broadcasts small ones and shuffles others, splitting hot ids.
    """
    own = score_inline(leads, rules)
    sizes = leads.groupBy(F.col(ID).alias(_SCORED_ID)).agg(F.count("*").alias("_n"))
    repeated = materialize(sizes.where(F.col("_n") > 1).select(_SCORED_ID), name="repeated")
    if repeated.isEmpty():
        return own.withColumn(COPIES, F.lit(1).cast("bigint"))
    same_id = leads[ID].eqNullSafe(repeated[_SCORED_ID])
    rows = leads.join(repeated, same_id, "left_semi")
    theirs = distinct_scores(score_leads(rows, rules)).select(
        F.col(ID).alias(_SCORED_ID),
        F.struct(*SCORE_COLUMNS, COPIES).alias("_theirs"),
    )
    theirs = materialize(theirs, name="scores")
    same_id = own[ID].eqNullSafe(theirs[_SCORED_ID])
    joined = own.join(theirs, same_id, "left").drop(_SCORED_ID)
    found = F.col("_theirs").isNotNull()
    return joined.withColumns(
        {
            **{
                c: F.when(found, F.col(f"_theirs.{c}")).otherwise(F.col(c))
                for c in SCORE_COLUMNS
            },
            COPIES: F.coalesce(F.col(f"_theirs.{COPIES}"), F.lit(1)),
        }
    ).drop("_theirs")


def expand_copies(compact: DataFrame, numbered: bool = False, spread: bool = False) -> DataFrame:
    """Every row as often as its ``_copies`` says; with ``numbered``, ``_copy`` counts them from 0.

    ``spread`` is for a written table (it is read twice): rows with many copies are dealt out to
    all tasks in blocks before they are multiplied, so that the rows of a hot id, which lie
    together, do not all multiply in one task. Only such rows are shuffled.
    """
    if spread:
        tasks = int(compact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = [ID] if ID in compact.columns else []
        few = compact.where(F.col(COPIES) <= COPY_BLOCK).withColumn(_BLOCK, F.lit(0).cast("bigint"))
        many = _blocks(compact.where(F.col(COPIES) > COPY_BLOCK)).repartition(tasks, _BLOCK, *key)
        blocks = few.unionByName(many)
    else:
        blocks = _blocks(compact)
    first = F.col(_BLOCK) * COPY_BLOCK
    last = F.least(first + COPY_BLOCK, F.col(COPIES)) - 1
    rows = blocks.withColumn(COPY_NO, F.explode(F.sequence(first, last))).drop(_BLOCK, COPIES)
    return rows if numbered else rows.drop(COPY_NO)


def _blocks(compact: DataFrame) -> DataFrame:
    """One row per block of copies, in two steps that keep every array short."""
    step = F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"({COPIES} - 1) div {COPY_BLOCK * BLOCK_STEP}")
    )
    first = F.col("_step") * BLOCK_STEP
    last = F.least(first + BLOCK_STEP - 1, F.expr(f"({COPIES} - 1) div {COPY_BLOCK}"))
    stepped = compact.withColumn("_step", F.explode(step))
    return stepped.withColumn(_BLOCK, F.explode(F.sequence(first, last))).drop("_step")


def enrich(leads: DataFrame, scored: DataFrame) -> DataFrame:
    """Left join on ``id`` with every pair as a row of its own."""
    return expand_copies(enrich_compact(leads, scored))


def match_counts(leads: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows the join would give, as (score, classification, copies) per id, without joining rows.

    Both sides are reduced to counts per id before they meet. Copies are decimals: ids with very many
    leads and scores have more pairs than a bigint holds.
    """
    left = leads.groupBy(ID).agg(F.count("*").alias("_leads"))
    right = (
        scored.groupBy(ID, SCORE, CLASS)
        .agg(F.count("*").alias("_scores"))
        .withColumnRenamed(ID, _SCORED_ID)
    )
    return left.join(right, left[ID].eqNullSafe(right[_SCORED_ID]), "left").select(
        ID,
        SCORE,
        CLASS,
        (F.col("_leads").cast(WIDE) * F.coalesce(F.col("_scores"), F.lit(1)).cast("decimal(18,0)"))
        .cast(WIDE)
        .alias(COPIES),
    )


def union_results(*parts: DataFrame) -> DataFrame:
    """Score rows of several origins in one table, copies kept."""
    columns = [ID, *SCORE_COLUMNS]
    typed = [
        p.select(
            F.col(ID).cast("string").alias(ID),
            F.col(SCORE).cast("double").alias(SCORE),
            F.col(CLASS).cast("string").alias(CLASS),
            F.col(REASON).cast("string").alias(REASON),
        )
        for p in parts
    ]
    total = typed[0].select(columns)
    for part in typed[1:]:
        total = total.unionByName(part)
    return total
