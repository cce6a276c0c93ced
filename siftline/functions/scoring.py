"""From phrase hits to score, class and reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import DEFAULT_RULES, HOT, JUNK, WARM, RuleBook


def rule_score(vip: Column, junk: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """Score of a lead from its phrase hits. Scores are set, not added: junk beats VIP."""
    return (
        F.when(junk.isNotNull(), F.lit(rules.junk_score))
        .when(vip.isNotNull(), F.lit(rules.vip_score))
        .otherwise(F.lit(rules.default_score))
    )


def classify(score: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return (
        F.when(score >= rules.hot_from, F.lit(HOT))
        .when(score < rules.junk_below, F.lit(JUNK))
        .otherwise(F.lit(WARM))
    )


def _filled(template: str, phrase: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), phrase, F.lit(after))


def reason_text(vip: Column, junk: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """VIP reason, then junk reason; the neutral sentence when neither list hits.

    ``concat`` is NULL for a missing phrase and ``concat_ws`` leaves NULLs out.
    """
    return F.concat_ws(
        rules.separator,
        _filled(rules.vip_reason, vip),
        _filled(rules.junk_reason, junk),
        F.when(vip.isNull() & junk.isNull(), F.lit(rules.neutral_reason)),
    )
