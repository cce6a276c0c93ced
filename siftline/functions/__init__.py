from siftline.functions.rating import format_rate, potential_rate
from siftline.functions.repair import (
    coerce_class,
    coerce_score,
    fill_reason,
    fill_text,
    parse_number,
)
from siftline.functions.responses import parse_scores, strip_fence
from siftline.functions.scoring import classify, reason_text, rule_score
from siftline.functions.text import first_keyword, normalize_text

__all__ = [
    "classify",
    "coerce_class",
    "coerce_score",
    "fill_reason",
    "fill_text",
    "first_keyword",
    "format_rate",
    "normalize_text",
    "parse_number",
    "parse_scores",
    "potential_rate",
    "reason_text",
    "rule_score",
    "strip_fence",
]
