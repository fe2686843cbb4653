"""Metadata: missing fields, generators, and fields given in several forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.regex import SPACE
from quillscan.functions.text import casefold
from quillscan.operators._findings import findings, union
from quillscan.tables import Tables

# Fixed values.
REQUIRED = ("title", "creator", "language", "identifier")
GENERATORS = ("generator", "created_by", "application", "software")
ALIASES = {"author": "creator", "creator": "creator", "dc.creator": "creator", "dc:creator": "creator", "title": "title", "dc.title": "title", "dc:title": "title"}
ACTION = "Review the EPUB package metadata and align it with the publication’s displayed information."


def normal(value: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(value), f"[{SPACE}]+", " "))


def named_values(tables: Tables) -> DataFrame:
    """Non-blank metadata under their common names, in order."""
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    key, value = casefold(F.col("key")), F.regexp_replace("value", f"^[{SPACE}]+|[{SPACE}]+$", "")
    return tables.metadata.select("book_id", "pos", F.coalesce(F.try_element_at(aliases, key), key).alias("name"), value.alias("value")).where("value <> ''")


def detect(tables: Tables, rules=None) -> DataFrame:
    """A displayed title is compared in the least of its candidates, so that the result does not depend on their order."""
    values = named_values(tables)
    first_chapter = tables.chapters.groupBy("book_id").agg(F.min(F.struct("chapter_seq", "file", "title")).alias("c"))
    books = tables.books.select("book_id", "source_path").join(first_chapter, "book_id", "left").select("book_id", F.coalesce("c.file", "source_path").alias("file"), F.coalesce("c.title", F.lit("")).alias("chapter"))
    tell = lambda rows, code, severity, reason: findings(rows, "metadata", code, severity, reason, ACTION, 0.5, par=0, sent=0)
    cited = lambda name, value: F.concat(F.lit("Metadata field “"), name, F.lit("”: "), F.substring(value, 1, 120))
    firsts = values.groupBy("book_id", "name").agg(F.min(F.struct("pos", "value"))["value"].alias("value"), F.countDistinct(normal(F.col("value"))).alias("forms"))
    required = books.select("*", F.explode(F.array(*map(F.lit, REQUIRED))).alias("name")).join(firsts.select("book_id", "name"), ["book_id", "name"], "left_anti")
    required = required.withColumn("text", F.concat(F.lit("Metadata field “"), F.col("name"), F.lit("”: absent or empty.")))
    missing_reason = F.concat(F.lit("Required-looking metadata field “"), F.col("name"), F.lit("” is absent or empty; review EPUB package completeness."))
    known = books.join(firsts, "book_id")
    made = known.where(F.col("name").isin(*GENERATORS)).withColumn("text", cited(F.col("name"), F.col("value")))
    made_reason = F.concat(F.lit("Generator metadata ("), F.col("name"), F.lit(": "), F.substring("value", 1, 120), F.lit(") is present; review whether it is intended for publication."))
    titled = known.where("name = 'title'").withColumn("text", cited(F.lit("title"), F.col("value")))
    shown = tables.chapters.groupBy("book_id").agg(F.collect_set(F.when(F.col("toc_title") != "", F.col("toc_title"))).alias("tocs"), F.collect_set(F.when(F.col("title") != "", F.col("title"))).alias("titles"))
    shown = shown.select("book_id", F.explode(F.when(F.size("tocs") > 0, F.col("tocs")).otherwise(F.col("titles"))).alias("shown"))
    other = (normal(F.col("shown")) != normal(F.col("value"))) & F.contains(normal(F.col("shown")), normal(F.col("value")))
    display = titled.join(shown, "book_id").where(other).groupBy("book_id", "file", "chapter", "value", "text").agg(F.min("shown").alias("shown"))
    display_reason = F.concat(F.lit("Package title “"), F.col("value"), F.lit("” differs from displayed title “"), F.col("shown"), F.lit("”; review whether the difference is intentional."))
    by = known.where("name = 'creator' and forms > 1").withColumn("text", cited(F.lit("creator"), F.col("value")))
    return union([
        tell(required, F.concat(F.lit("missing_"), F.col("name")), "medium", missing_reason),
        tell(made, "generator_metadata", "low", made_reason),
        tell(display, "title_display_variant", "low", display_reason),
        tell(titled.where("forms > 1"), "title_metadata_variant", "medium", "Title metadata uses multiple title forms; review whether they intentionally describe the same publication."),
        tell(by, "author_metadata_variant", "medium", "Creator metadata uses multiple author-name forms; review whether they intentionally identify the same contributor."),
    ])
