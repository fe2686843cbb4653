"""Consistency: several ages, dates, percentages or numbers in a paragraph, and forms of a name across the book."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.regex import SPACE, java
from quillscan.functions.text import casefold, matches, may_hold
from quillscan.operators._findings import exploded, findings, union, wanted
from quillscan.operators.style import first_sentence
from quillscan.tables import Tables

# Fixed values.
NUMBER = java(r"(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:\s*(?:%|percent|por ciento))?")
AGE = java(r"\b(\d{1,3})\s*(?:years? old|años?)\b")
DATE = java(r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\s+\d{1,2},?\s+\d{4})\b")
# What every date has: digits around a mark, or a letter, one or two digits and a year, apart by white space.
DATED = rf"\p{{Nd}}[/-]\p{{Nd}}|\p{{L}}[{SPACE}]+\p{{Nd}}{{1,2}},?[{SPACE}]+\p{{Nd}}{{4}}"
NAME = java(r"\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,2}\b", ignore_case=False)
ACTION = "Compare the referenced passages and confirm the intended value or wording."


def values(paragraphs: DataFrame, numbers: bool = True) -> DataFrame:
    """Paragraphs with their distinct ages, dates, numbers and percentages; those without a digit are left out.

    Ages and dates are only looked for where a cheaper test finds what each of them needs; numbers and percentages are
    empty where they are not wanted.
    """
    none = F.array().cast("array<string>")
    fold = lambda pattern, when: F.when(when, F.array_distinct(F.transform(matches(F.col("text"), pattern), casefold))).otherwise(none)
    rows = paragraphs.where(F.col("text").rlike(r"\p{Nd}"))
    ages, dates = may_hold(F.col("text"), ["year old", "years old", "año"]), F.col("text").rlike(DATED)
    rows = rows.withColumns({"ages": fold(AGE, ages), "dates": fold(DATE, dates), "numbers": F.array_distinct(matches(F.col("text"), NUMBER)) if numbers else none})
    return rows.withColumn("percentages", F.filter("numbers", lambda x: x.contains("%") | casefold(x).contains("percent") | casefold(x).contains("por ciento")))


def names(sentences: DataFrame) -> DataFrame:
    """Distinct full names of a book with their surname and the first sentence that has them."""
    rows = sentences.select("book_id", "ord", "file", "chapter", "par", "sent", "text", F.explode(matches(F.col("text"), NAME)).alias("name"))
    firsts = rows.groupBy("book_id", "name").agg(F.min(F.struct("ord", "file", "chapter", "par", "sent", "text")).alias("f"))
    return firsts.select("book_id", "name", casefold(F.element_at(F.split("name", " "), -1)).alias("surname"), "f.*")


def detect(tables: Tables, rules=None, only=None) -> DataFrame:
    """Findings of the codes in ``only``, or of all."""
    listed = lambda label, column: F.concat(F.lit(f"This paragraph contains multiple {label} expressions ("), F.array_join(F.array_sort(column), ", "), F.lit("); this is a review signal, not a factual-error claim."))
    many = lambda column: F.size(column) > 1
    asked = [name for name, codes in (("ages", ["multiple_ages"]), ("dates", ["multiple_dates"]), ("numbers", ["multiple_percentages", "multiple_numbers"])) if wanted(only, *codes)]
    rows = values(tables.paragraphs, numbers="numbers" in asked).where(reduce(Column.__or__, [many(name) for name in asked], F.lit(False)))
    rows = first_sentence(tables, rows, needed=True)
    in_paragraphs = exploded(rows, "consistency", [
        (many("ages"), "multiple_ages", "medium", listed("age", "ages"), 0.5),
        (many("dates"), "multiple_dates", "medium", listed("date", "dates"), 0.5),
        (many("percentages"), "multiple_percentages", "medium", "Multiple percentage expressions occur in one paragraph; review their denominator and context.", 0.5),
        (many("numbers"), "multiple_numbers", "medium", "Multiple numeric expressions occur in one paragraph; review whether their units and references are clear.", 0.5),
    ], ACTION, only=only)
    forms = names(tables.sentences).groupBy("book_id", "surname").agg(F.array_sort(F.collect_list("name")).alias("names"), F.min(F.struct("name", "file", "chapter", "par", "sent", "text")).alias("f")).where(F.size("names") > 1).select("*", "f.*")
    reason = F.concat(F.lit("Names sharing the surname “"), F.col("surname"), F.lit("” use multiple full-name forms ("), F.array_join("names", ", "), F.lit("); review whether they identify the same person."))
    variants = findings(forms, "consistency", "name_variant", "medium", reason, ACTION, 0.5)
    return union([in_paragraphs, variants]) if wanted(only, "name_variant") else in_paragraphs
