"""Structure of a book: openings, endings, headings, numbering, contents, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions.regex import SPACE, java
from quillscan.functions.text import casefold, may_hold, percent, words
from quillscan.operators._findings import exploded, findings, setting, union, wanted
from quillscan.operators.style import first_sentence
from quillscan.tables import FINDINGS, Tables

# Fixed values.
NUMBER = java(r"^(?:chapter|chapitre|capítulo|第)\s*([\divxlcdm]+)")
REMNANT = java(r"\b(?:todo|tbd|xxx|lorem ipsum|insert (?:text|image)|draft(?:ing)? note)\b|(?:待补充|占位符|草稿)")
CONNECTORS = ["however", "therefore", "moreover", "furthermore", "additionally", "meanwhile", "nevertheless", "然而", "因此", "此外", "同时", "不过"]
REMNANT_NEEDS = ["todo", "tbd", "xxx", "lorem ipsum", "insert text", "insert image", "draft note", "drafting note", "待补充", "占位符", "草稿"]
ACTION = "Check the book structure and revise the source or navigation metadata as needed."


def chapter_keys(tables: Tables) -> DataFrame:
    """Chapters with their first and last sentence, the keys of both, and the shape of their headings."""
    blank = F.trim(F.regexp_replace("text", f"[{SPACE}]+", " ")) == ""
    place = F.struct("ord", "par", "sent", "text")
    ends = tables.sentences.where(~blank).groupBy("book_id", "chapter_seq").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    w = lambda c: words(casefold(F.col(c)))
    shape = F.transform("headings", lambda h: casefold(F.regexp_replace(h, r"\p{Nd}+", "#")))
    rows = tables.chapters.join(ends, ["book_id", "chapter_seq"], "left").withColumn("shape", shape)
    opening = F.array_join(F.slice(w("first.text"), 1, 8), " ")
    closing = F.array_join(F.slice(w("last.text"), F.greatest(F.size(w("last.text")) - 7, F.lit(1)), 8), " ")
    return rows.withColumn("opening", opening).withColumn("closing", closing)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key more than one chapter of the book has; counted before they are joined, so a common key is no hot spot."""
    common = rows.where(F.col(key).isNotNull()).groupBy("book_id", key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    return rows.join(common, ["book_id", key], "left_semi")


def detect(tables: Tables, rules=None, only=None) -> DataFrame:
    """Findings of the codes in ``only``, or of all."""
    of = lambda name, default: setting(rules, "structure", name, default)
    if not of("enabled", True):
        return tables.sentences.sparkSession.createDataFrame([], FINDINGS)
    tell = lambda rows, code, reason, weight=1.0, **at: findings(rows, "structure", code, "medium", reason, ACTION, weight, **at)
    remnants = first_sentence(tables, tables.paragraphs.where(may_hold(F.col("text"), REMNANT_NEEDS)).where(F.col("text").rlike(REMNANT)))
    keys = chapter_keys(tables)
    at = lambda end: {"text": f"{end}.text", "par": f"{end}.par", "sent": f"{end}.sent", "chapter": "title"}
    shaped = repeated(keys.where(F.size("shape") > 0), "shape").withColumns({"t": F.coalesce("first.text", "title"), "p": F.coalesce("first.par", F.lit(0)), "s": F.coalesce("first.sent", F.lit(0))})
    reading = Window.partitionBy("book_id").orderBy("chapter_seq")
    title = F.coalesce("title", F.lit(""))
    number = F.when(title.rlike(NUMBER), F.regexp_extract(title, NUMBER, 1))
    numbered = tables.chapters.withColumn("number", number)
    numbered = numbered.withColumn("expected", 1 + F.coalesce(F.sum(F.col("number").isNotNull().cast("long")).over(reading.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = numbered.where(F.col("number").rlike(r"^\p{Nd}+$") & (F.col("number").cast("decimal(38,0)") != F.col("expected")))
    gap_reason = F.concat(F.lit("Chapter numbering expected "), F.col("expected").cast("string"), F.lit(", found "), F.col("number"), F.lit("."))
    listed = tables.chapters.where("toc_title <> ''").withColumn("key", casefold(strip("toc_title")))
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy("book_id", "key").orderBy("chapter_seq"))).where((F.col("nth") > 1) | (F.col("key") != casefold(strip("title"))))
    head = {"text": "title", "par": 0, "sent": 0, "chapter": "title"}
    tokens = tables.paragraphs.select("book_id", F.explode(words(casefold(F.col("text")))).alias("word"))
    by_word = tokens.groupBy("book_id", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = by_word.groupBy("book_id").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), F.sum(F.when(F.col("word").isin(CONNECTORS), F.col("n")).otherwise(0)).alias("connectors"))
    first_chapter = tables.chapters.groupBy("book_id").agg(F.min(F.struct("chapter_seq", "file", "title")).alias("c")).select("book_id", "c.file", "c.title")
    totals = totals.join(first_chapter, "book_id").withColumn("diversity", F.col("distinct") / F.col("total")).withColumn("ratio", F.col("connectors") / F.col("total"))
    vocabulary = exploded(totals, "structure", [
        (F.col("diversity") < float(of("vocabulary_diversity_min", 0.35)), "low_vocabulary_diversity", "medium", F.concat(F.lit("Book vocabulary diversity is "), percent(F.col("diversity")), F.lit(".")), 1 - F.col("diversity")),
        (F.col("ratio") >= float(of("connector_ratio_threshold", 0.03)), "connector_density", "medium", F.concat(F.lit("Connector words account for "), percent(F.col("ratio"), 1), F.lit(" of words.")), F.col("ratio")),
    ], ACTION, only, **head)
    parts = {
        "editorial_remnant": tell(remnants, "editorial_remnant", "Possible editorial placeholder or drafting note."),
        "repeated_chapter_start": tell(repeated(keys.where("first is not null"), "opening"), "repeated_chapter_start", "Opening phrase is repeated across chapters.", **at("first")),
        "repeated_chapter_end": tell(repeated(keys.where("last is not null"), "closing"), "repeated_chapter_end", "Closing phrase is repeated across chapters.", **at("last")),
        "repeated_heading_structure": tell(shaped, "repeated_heading_structure", "Heading structure is repeated across chapters.", text="t", par="p", sent="s", chapter="title"),
        "chapter_number_gap": tell(gaps, "chapter_number_gap", gap_reason, **head),
        "toc_title_issue": tell(listed, "toc_title_issue", "TOC title is duplicate or differs from the chapter title.", **head),
    }
    parts = [part for code, part in parts.items() if wanted(only, code)] + [vocabulary] * wanted(only, "low_vocabulary_diversity", "connector_density")
    return union(parts) if parts else tables.sentences.sparkSession.createDataFrame([], FINDINGS)


def strip(column: str):
    """Without white space at the ends."""
    return F.regexp_replace(column, f"^[{SPACE}]+|[{SPACE}]+$", "")
