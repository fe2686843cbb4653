"""Scores of findings by category, their weighted total, and its band."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.plans.rules import CATEGORIES, CATEGORY_WEIGHTS, DISCLAIMER, SEVERITIES, SEVERITY_WEIGHTS

# Bands by upper bound.
BANDS = ((30, "낮은 위험"), (60, "추가 자료 확인 필요"), (80, "사람 검토 필요"), (None, "우선 검토 필요"))


def _at(rules: Mapping[str, Any], *path: str) -> Any:
    for key in path:
        rules = rules.get(key) if isinstance(rules, Mapping) else None
    return rules


def _float(value: Any, default: float) -> float:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def effective_weight(rules: Mapping[str, Any]) -> Column:
    """A finding's own weight, or its severity's where it has none."""
    by = F.lit(1.0)
    for severity in {**SEVERITY_WEIGHTS, **(_at(rules, "weights", "severity") or {})}:
        value = max(0.0, _float(_at(rules, "weights", "severity", severity), SEVERITY_WEIGHTS.get(severity, 1.0)))
        by = F.when(F.lower("severity") == severity, value).otherwise(by)
    return F.when(F.col("weight") > 0, F.col("weight")).otherwise(by)


def category_scores(findings: DataFrame, books: DataFrame, rules: Mapping[str, Any]) -> DataFrame:
    """(book_id, category, score): every book has every category, 0 to the cap. ``findings`` are free of duplicates."""
    points = _float(_at(rules, "thresholds", "category_score_points"), 10.0)
    points = points if points > 0 else 10.0
    cap = min(100.0, max(0.0, _float(_at(rules, "scoring", "category_score_cap"), 100.0)))
    sums = findings.groupBy("book_id", "category").agg(F.sum(effective_weight(rules)).alias("total"))
    grid = books.select("book_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return grid.join(sums, ["book_id", "category"], "left").select("book_id", "category", F.least(F.lit(cap), F.coalesce("total", F.lit(0.0)) / points * 100.0).alias("score"))


def total_score(rules: Mapping[str, Any]) -> Column:
    """Aggregate over a book's category scores, in the categories' fixed order."""
    by = F.map_from_entries(F.collect_list(F.struct("category", "score")))
    total = F.lit(0.0)
    for c in CATEGORIES:
        total = total + F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(by, F.lit(c)), F.lit(0.0))) * max(0.0, _float(_at(rules, "weights", "category", c), CATEGORY_WEIGHTS[c]))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.least(F.lit(_float(_at(rules, "scoring", "maximum_score"), 100.0)), total)))


def risk_level(score: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for bound, name in reversed(BANDS[:-1]):
        out = F.when(score < bound, name).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITIES.items():
        out = F.when(F.lower(severity) == name, rank).otherwise(out)
    return out


def disclaimer(rules: Mapping[str, Any]) -> str:
    text = _at(rules, "scoring", "disclaimer")
    return text if isinstance(text, str) and text.strip() else DISCLAIMER


def summaries(findings: DataFrame, scores: DataFrame, languages: DataFrame, rules: Mapping[str, Any], verify_links: bool = False) -> DataFrame:
    """One row for each book of ``languages``."""
    totals = scores.groupBy("book_id").agg(total_score(rules).alias("overall_score"))
    counts = findings.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("severity"))).alias("top"))
    rows = languages.join(totals, "book_id").join(counts, "book_id", "left")
    return rows.select(
        "book_id", F.coalesce("n", F.lit(0)).alias("finding_count"), "overall_score", risk_level(F.col("overall_score")).alias("risk_level"), "language",
        F.lit(verify_links).alias("link_verification"), F.coalesce(F.lower("top.severity"), F.lit("none")).alias("highest_finding_severity"), F.lit(disclaimer(rules)).alias("disclaimer"),
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category, and by chapter (or file), in one pass."""
    place = F.coalesce(F.when(F.col("chapter") != "", F.col("chapter")), F.col("file"))
    rows = findings.select("book_id", F.explode(F.array(*[F.struct(F.lit(k).alias("by"), c.alias("value")) for k, c in (("severity", F.col("severity")), ("category", F.col("category")), ("chapter", place))])).alias("g"))
    return rows.groupBy("book_id", "g.by", "g.value").agg(F.count(F.lit(1)).alias("n"))
