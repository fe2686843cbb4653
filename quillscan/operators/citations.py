"""Citations: markers, DOIs, URLs, inline references and figures without a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.regex import java
from quillscan.functions.text import casefold, matches, may_hold
from quillscan.operators._findings import exploded
from quillscan.tables import Tables

# Patterns, hosts and reasons.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
DOI_REFERENCE = java(r"\b(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)([^\s<>\])}]+)")
URL = java(r"https?://[^\s<>\])}]*")
CITATION = java(r"(?:\[[0-9,;\s]+\]|\([A-Z][A-Za-z-]+,?\s+(?:19|20)\d{2}[a-z]?\))", ignore_case=False)
SOURCE_NEEDED = java(r"\b(?:citation needed|citation required|source needed|source required|fuente necesaria|se necesita (?:una )?fuente|requiere (?:una )?fuente)\b")
STATISTIC = java(r"\b(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)\s*%|\b(?:one|\d+)\s+in\s+\d+\b|\b\d+\s+(?:million|billion|mil(?:lones)?|millones)\b")
PLACEHOLDER = java(r"\b(?:todo|tbd|placeholder|insert|xxx)\b")
PLACEHOLDER_HOSTS = ["example.com", "example.org", "example.net", "invalid", "localhost"]
# What every signal needs one of, where there is no digit.
NEEDLES = ("http", "doi", "citation ", "source ", "fuente", "[")
ACTION = "Review the surrounding claim and add, correct, or document an appropriate source where needed."
REASONS = {
    "source_needed_marker": "The text includes a source-needed marker; review whether a citation should be supplied.",
    "malformed_doi": "A DOI is explicitly marked but does not match the expected DOI format; review the reference text.",
    "doi_present": "A DOI appears in running text; review its formatting and whether its reference details are complete.",
    "empty_url": "A URL scheme has no host value; review whether a complete source link should be supplied.",
    "placeholder_url": "A URL contains placeholder text or a documentation-only host; review the intended source link.",
    "url_present": "A URL appears in running text; review its presentation and supporting reference context.",
    "citation_present": "An inline citation-like pattern appears; review its consistency with the book’s citation style.",
    "uncited_statistic_candidate": "A quantitative claim has no nearby inline citation pattern; review whether context or a source should accompany it.",
}


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "[.,;:!?]+$", "")


def _tail(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^https?://", "")


def _is_empty(url: Column) -> Column:
    return (_tail(url) == "") | _tail(url).rlike("^[/?#]")


def _is_placeholder(url: Column) -> Column:
    authority = F.substring_index(_tail(url), "/", 1)
    host = casefold(F.substring_index(F.substring_index(authority, "@", -1), ":", 1))
    return ~_is_empty(url) & (host.isin(PLACEHOLDER_HOSTS) | url.rlike(PLACEHOLDER))


def signals(sentences: DataFrame) -> DataFrame:
    """Sentences with the facts that citation signals are made of; arrays are only built where a URL or DOI stands."""
    text = F.col("text")
    urls = F.when(F.lower("text").contains("http"), F.transform(matches(text, URL), _trimmed)).otherwise(F.array().cast("array<string>"))
    marked = F.when(F.lower("text").contains("doi"), F.transform(matches(text, DOI_REFERENCE, 1), _trimmed)).otherwise(F.array().cast("array<string>"))
    whole = java(f"^(?:{DOI})$")
    rows = sentences.withColumns({"urls": urls, "marked": marked})
    return rows.withColumns({
        "source_needed": text.rlike(SOURCE_NEEDED),
        "has_doi": text.rlike(java(DOI)) | F.exists("marked", lambda c: c.rlike(whole)),
        "malformed": F.exists("marked", lambda c: ~c.rlike(whole)),
        "empty_url": F.exists("urls", _is_empty),
        "placeholder": F.exists("urls", _is_placeholder),
        "has_url": F.exists("urls", lambda u: ~_is_empty(u)),
        "cited": text.rlike(CITATION),
        "statistic": text.rlike(STATISTIC),
    })


def may_match() -> Column:
    """Whether a sentence may have a signal; cheap."""
    return F.col("text").rlike(r"\p{Nd}") | may_hold(F.col("text"), NEEDLES)


def detect(tables: Tables, rules=None) -> DataFrame:
    c = F.col
    of = [
        (c("source_needed"), "source_needed_marker", "medium"), (c("malformed"), "malformed_doi", "medium"), (c("has_doi"), "doi_present", "low"),
        (c("empty_url"), "empty_url", "medium"), (c("placeholder"), "placeholder_url", "medium"), (c("has_url"), "url_present", "low"), (c("cited"), "citation_present", "low"),
        (c("statistic") & ~(c("has_doi") | c("has_url") | c("cited")), "uncited_statistic_candidate", "medium"),
    ]
    return exploded(signals(tables.sentences.where(may_match())), "citations", [(when, code, severity, REASONS[code], 0.5) for when, code, severity in of], ACTION)
