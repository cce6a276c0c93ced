"""Spark-native triage of sales prospects: score, join, measure, review, hand over."""

from siftline.config import DEFAULT_RULES, RuleBook

__all__ = ["DEFAULT_RULES", "RuleBook"]
