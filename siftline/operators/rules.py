"""Keyword scoring as column projections: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import (
    CLASS,
    DEFAULT_RULES,
    ID,
    NEED,
    REASON,
    SCORE,
    SCORE_COLUMNS,
    RuleBook,
)
from siftline.functions.scoring import classify, reason_text, rule_score
from siftline.functions.text import first_keyword, normalize_text

_TEXT = "_text"
VIP = "_vip"
JUNK_HIT = "_junk"


class ColumnClash(ValueError):
    """The lead table already has a column that scoring would add."""


def reject_score_columns(leads: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    taken = (*SCORE_COLUMNS, *reserved)
    clash = [c for c in leads.columns if c.lower() in taken]
    if clash:
        raise ColumnClash(f"lead table already has {', '.join(clash)}")
    return leads


def add_phrase_hits(leads: DataFrame, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """``leads`` with the first VIP and the first junk phrase of each row in ``_vip``, ``_junk``.

    The lower-cased text is a step of its own, so that it is made once per row and not once per
    phrase; Catalyst leaves the step alone because its result is used many times.
    """
    need = F.col(NEED) if NEED in leads.columns else F.lit(None)
    return (
        leads.withColumn(_TEXT, normalize_text(need))
        .withColumns(
            {
                VIP: first_keyword(F.col(_TEXT), rules.vip_phrases),
                JUNK_HIT: first_keyword(F.col(_TEXT), rules.junk_phrases),
            }
        )
        .drop(_TEXT)
    )


def score_inline(leads: DataFrame, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """``leads`` with score, classification and reason of each row's own text.

    Equal to scoring and joining back where ``id`` is unique, without the join.
    """
    reject_score_columns(leads)
    vip, junk = F.col(VIP), F.col(JUNK_HIT)
    return (
        add_phrase_hits(leads, rules)
        .withColumn(SCORE, rule_score(vip, junk, rules).cast("double"))
        .withColumns(
            {
                CLASS: classify(F.col(SCORE), rules),
                REASON: reason_text(vip, junk, rules),
            }
        )
        .drop(VIP, JUNK_HIT)
    )


def score_leads(leads: DataFrame, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """One score row per lead: id, score, classification, reason."""
    key = F.col(ID).cast("string") if ID in leads.columns else F.lit(None).cast("string")
    need = F.col(NEED) if NEED in leads.columns else F.lit(None).cast("string")
    return score_inline(leads.select(key.alias(ID), need.alias(NEED)), rules).drop(NEED)
