"""Severity, risk and confidence as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels in order, score cut-offs, confidence cut-offs and labels.
LEVELS = ("critical", "high", "medium", "low", "info")
UNKNOWN_RANK = 9
SCORE_CUTS = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"))
CONFIDENCE_CUTS = ((0.80, "高"), (0.60, "中"))
CONFIDENCE_LOW = "低"
VULNERABLE_STATES = ("VULNERABLE", "LIKELY VULNERABLE")


def level_rank(level: Column) -> Column:
    """0 for critical to 4 for info; 9 for anything else and for null."""
    ranks = F.create_map(*[x for k, name in enumerate(LEVELS) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(UNKNOWN_RANK))


def score_to_severity(score: Column) -> Column:
    """The level of a 0 to 10 score; null stays null."""
    level = F.when(score.isNull(), F.lit(None).cast("string"))
    for cut, name in SCORE_CUTS:
        level = level.when(score >= cut, F.lit(name))
    return level.otherwise(F.lit("low"))


def parse_score(text: Column) -> Column:
    """The number that a text starts with, or null."""
    return F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")


def is_vulnerable_state(state: Column) -> Column:
    found = F.lit(False)
    for prefix in VULNERABLE_STATES:
        found = found | state.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def fallback_risk(severity: Column, alert_risk: Column) -> Column:
    """A severity above info; else the alert's own risk; else info."""
    return F.when(severity.isin(*LEVELS[:4]), severity).when(alert_risk.isin(*LEVELS), alert_risk).otherwise(F.lit("info"))


def confidence_label(score: Column) -> Column:
    label = F.when(score.isNull(), F.lit(None).cast("string"))
    for cut, name in CONFIDENCE_CUTS:
        label = label.when(score >= cut, F.lit(name))
    return label.otherwise(F.lit(CONFIDENCE_LOW))
