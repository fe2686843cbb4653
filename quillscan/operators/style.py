"""Distribution of style: sentence length, punctuation, passive voice, nominalisation, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.functions.regex import SPACE, java
from quillscan.functions.text import split_sentences, words
from quillscan.operators._findings import exploded, findings, setting, union, wanted
from quillscan.tables import FINDINGS, Tables

# Fixed values.
PASSIVE = java(r"\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b")
NOMINAL = java(r"^\w+(?:tion|sion|ment|ness|ity|ance|ence)$")
LIST_ITEM = "(?m)" + java(r"(?:^|\n)\s*(?:[-*•]|\d+[.)])\s+", ignore_case=False)
ACTION = "Review this pattern in context and revise only where it affects readability or voice."


def measured(tables: Tables) -> DataFrame:
    """Sentences with their tokens, and what style is judged by."""
    w = words(F.col("text"))
    marks = F.length(F.regexp_replace("text", rf"[\p{{L}}\p{{N}}{SPACE}]", ""))
    rows = tables.sentences.withColumn("w", w)
    return rows.withColumn("n_words", F.size("w")).withColumn("marks", marks).withColumn("is_passive", F.col("text").rlike(PASSIVE)).withColumn("nominals", F.size(F.filter("w", lambda x: x.rlike(NOMINAL))))


def detect(tables: Tables, rules=None, only=None) -> DataFrame:
    """Findings of the codes in ``only``, or of all."""
    of = lambda name, default: setting(rules, "style_patterns", name, default)
    if not of("enabled", True):
        return tables.sentences.sparkSession.createDataFrame([], FINDINGS)
    most, density, passive, nominal, items = int(of("max_sentence_words", 40)), float(of("max_punctuation_ratio", 0.18)), float(of("passive_ratio_threshold", 0.35)), float(of("nominal_ratio_threshold", 0.20)), int(of("list_item_threshold", 3))
    rows, n = measured(tables), F.col("n_words")
    by_sentence = exploded(rows.where("n_words > 0"), "style_patterns", [
        (n > most, "long_sentence", "low", F.concat(F.lit("Sentence has "), n.cast("string"), F.lit(f" words, above configured review threshold {most}.")), n / F.lit(float(most))),
        (F.col("marks") / F.greatest(F.length("text"), F.lit(1)) > density, "punctuation_density", "low", "Punctuation density is above the configured review threshold.", 1.0),
    ], ACTION, only=only)
    chapters = rows.groupBy("book_id", "chapter_seq").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(((n > 0) & F.col("is_passive")).cast("long")).alias("passives"), F.sum("n_words").alias("words"), F.sum("nominals").alias("nominals"),
        F.min(F.struct("ord", "file", "chapter", "par", "sent", "text")).alias("f"),
    ).select("*", "f.*")
    ratio = F.col("passives") / F.col("sentences")
    share = F.when(F.col("words") > 0, F.col("nominals") / F.col("words"))
    told = lambda a, b, what: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"), F.lit(what))
    by_chapter = exploded(chapters, "style_patterns", [
        (ratio >= passive, "passive_distribution", "low", told("passives", "sentences", " sentences match a passive-voice heuristic."), ratio),
        (share >= nominal, "nominalization_distribution", "low", told("nominals", "words", " words match nominalization endings."), share),
    ], ACTION, only=only)
    lists = tables.paragraphs.where(F.regexp_count("text", F.lit(LIST_ITEM)) >= items).select("book_id", "chapter_seq", "par", "file", "chapter", "text")
    lists = first_sentence(tables, lists)
    by_list = [findings(lists, "style_patterns", "list_density", "low", "Paragraph contains several list markers.", ACTION, 1.0)]
    parts = [by_sentence] * wanted(only, "long_sentence", "punctuation_density") + [by_chapter] * wanted(only, "passive_distribution", "nominalization_distribution") + by_list * wanted(only, "list_density")
    return union(parts) if parts else lists.sparkSession.createDataFrame([], FINDINGS)


def first_sentence(tables: Tables, paragraphs: DataFrame, needed: bool = False) -> DataFrame:
    """Paragraph rows with their first sentence's text in place of their own; without a sentence dropped if ``needed``.

    Where sentences are cut from the paragraphs, only these rows are cut again, and no other paragraph is.
    """
    if tables.cut:
        rows = paragraphs.withColumn("first", F.get(split_sentences(F.col("text")), F.lit(0)))
        rows = rows.where(F.col("first").isNotNull()) if needed else rows
        return rows.withColumn("text", F.coalesce("first", "text")).withColumn("sent", F.lit(0))
    first = tables.sentences.where("sent = 0").select("book_id", "chapter_seq", "par", F.col("text").alias("first"))
    rows = paragraphs.join(first, ["book_id", "chapter_seq", "par"], "inner" if needed else "left")
    return rows.withColumn("text", F.coalesce("first", "text")).withColumn("sent", F.lit(0))
