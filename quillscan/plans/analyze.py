"""The whole analysis of books, and the comparison of two."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.operators import DETECTORS
from quillscan.operators._findings import union
from quillscan.operators.links import link_findings
from quillscan.plans import post, scoring
from quillscan.plans.rules import load_rules
from quillscan.tables import Tables


@dataclass(frozen=True)
class Analysis:
    tables: Tables
    findings: DataFrame
    category_scores: DataFrame
    summary: DataFrame

    def release(self) -> None:
        """Free the findings and all that was persisted for the tables."""
        self.findings.unpersist()
        self.tables.unpersist()


def detected(tables: Tables, rules: Mapping[str, Any], only: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the detectors that the exclusions leave."""
    return union([detect(tables, rules) for name, detect in DETECTORS.items() if not only or name in only]).where(~post.excluded(rules))


def analyze(tables: Tables, rules: Mapping[str, Any] | None = None, language: str = "auto", verify_links: bool = False, check=None) -> Analysis:
    """Findings, category scores and summary of every book in ``tables``. Links are only checked where asked for.

    The findings are kept, since scores, summaries and reports all read them.
    """
    rules = load_rules() if rules is None else rules
    languages = post.resolve_language(tables, language)
    found = detected(tables, rules)
    if verify_links:
        found = found.unionByName(link_findings(tables, rules, check))
    found = post.identified(post.deduplicated(post.localized(found, languages))).persist()
    scores = scoring.category_scores(found, tables.books, rules)
    return Analysis(tables, found, scores, scoring.summaries(found, scores, languages, rules, verify_links))


def compared(scores: DataFrame, summary: DataFrame, left: str, right: str) -> DataFrame:
    """(category, score_delta) of two books, right less left, and the same of the overall score under ``overall``."""
    both = scores.select("book_id", "category", "score").unionByName(summary.select("book_id", F.lit("overall").alias("category"), F.col("overall_score").alias("score")))
    of = lambda book: F.max(F.when(F.col("book_id") == book, F.col("score")))
    return both.where(F.col("book_id").isin(left, right)).groupBy("category").agg((of(right) - of(left)).alias("score_delta"))


def search(findings: DataFrame, category: str = "", severity: str = "", place: str = "", text: str = "") -> DataFrame:
    """Findings by category, severity, chapter or file, and words in any of their texts (case ignored); blank: all."""
    out = findings
    if category:
        out = out.where(F.col("category") == category)
    if severity:
        out = out.where(F.col("severity") == severity)
    if place:
        out = out.where(F.coalesce(F.when(F.col("chapter") != "", F.col("chapter")), F.col("file")) == place)
    if text:
        out = out.where(F.instr(F.lower(F.concat_ws(" ", "excerpt", "reason", "review_action", "chapter", "file")), text.lower()) > 0)
    return out


def fails(summary: DataFrame, threshold: str) -> DataFrame:
    """(book_id, fails): whether severity or score meets ``high`` (60) or ``critical`` (80); ``never`` never."""
    if threshold == "never":
        return summary.select("book_id", F.lit(False).alias("fails"))
    rank, score = {"high": (3, 60.0), "critical": (4, 80.0)}[threshold]
    return summary.select("book_id", ((scoring.severity_rank(F.col("highest_finding_severity")) >= rank) | (F.col("overall_score") >= score)).alias("fails"))
