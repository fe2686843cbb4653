"""The relational form of books: what every detector reads."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.functions.text import split_paragraphs, split_sentences

BOOKS = "book_id string, source_path string, sha256 string"
METADATA = "book_id string, pos int, key string, value string"
CHAPTERS = "book_id string, chapter_seq long, file string, title string, toc_title string, headings array<string>"
PARAGRAPHS = "book_id string, chapter_seq long, file string, chapter string, par int, text string"
SENTENCES = "book_id string, chapter_seq long, file string, chapter string, par int, sent int, ord struct<chapter_seq:bigint,par:int,sent:int>, text string"
RESOURCES = "book_id string, res_seq int, path string, media_type string, size long, sha256 string, referenced boolean, alt_text string, width int, height int"
FINDINGS = "book_id string, severity string, category string, code string, file string, chapter string, paragraph int, sentence int, excerpt string, reason string, review_action string, weight double"


@dataclass(frozen=True)
class Tables:
    """Books, their metadata, chapters, paragraphs, sentences and resources."""

    books: DataFrame
    metadata: DataFrame
    chapters: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame
    resources: DataFrame
    #: Frames that were persisted to make these.
    kept: tuple[DataFrame, ...] = ()
    #: Whether sentences are those of ``sentences_of(paragraphs)``, so that a paragraph's own can be cut from its text again.
    cut: bool = False

    def persisted(self) -> Tables:
        """Keep paragraphs and sentences, which several detectors read."""
        held = [self.chapters.persist(), self.paragraphs.persist(), self.sentences.persist()]
        return replace(self, chapters=held[0], paragraphs=held[1], sentences=held[2], kept=(*self.kept, *held))

    def unpersist(self) -> None:
        """Free everything that was persisted for these tables."""
        for df in self.kept:
            df.unpersist()


def reading_order(sent: Column) -> Column:
    """Sort key of a sentence within its book; made of the row alone, so that no detector needs a shuffle for it."""
    return F.struct("chapter_seq", "par", sent.cast("int").alias("sent"))


def sentences_of(paragraphs: DataFrame) -> DataFrame:
    """Sentences of paragraphs, with their place in the reading order. A map over rows."""
    rows = paragraphs.select("book_id", "chapter_seq", "file", "chapter", "par", F.posexplode(split_sentences(F.col("text"))).alias("sent", "text"))
    return rows.withColumn("ord", reading_order(F.col("sent")))


def numbered(sentences: DataFrame) -> DataFrame:
    """Sentences with ``sent_seq``, their number in the book from 1.

    Numbers are counted within chapters and shifted by the sentences of the chapters before, so that only one row for
    each chapter is ever sorted together.
    """
    sizes = sentences.groupBy("book_id", "chapter_seq").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    place = F.row_number().over(Window.partitionBy("book_id", "chapter_seq").orderBy("ord"))
    offsets = sizes.select("book_id", "chapter_seq", before.alias("before"))
    return sentences.withColumn("place", place).join(offsets, ["book_id", "chapter_seq"]).withColumn("sent_seq", F.col("before") + F.col("place")).drop("before", "place")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: Bytes that a task is expected to read, and at most those that it gets where rows are dealt out, as work on text takes minutes for more.
SPLIT, DEALT = 128 << 20, 16 << 20


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over all cores where they may come in fewer parts than there are cores, as from a small file of one row group.

    That is told from the size that the optimizer estimates, so nothing is run.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(cores, -(-size // DEALT)), *keys) if size < cores * SPLIT else rows


def from_texts(rows: DataFrame, nfkc: bool = True, max_bytes: int | None = None) -> Tables:
    """Books from (book_id, chapter_seq, file, title, text) rows, one plain-text chapter each.

    With ``max_bytes``, reading paragraphs or sentences of a longer text fails.
    """
    spark = rows.sparkSession
    if max_bytes is not None:
        told = F.concat(F.lit(f"Text exceeds {max_bytes} bytes: "), F.coalesce("book_id", F.lit("")), F.lit("/"), F.coalesce("file", F.lit("")))
        rows = rows.withColumn("text", F.when(F.octet_length("text") > max_bytes, F.raise_error(told).cast("string")).otherwise(F.col("text")))
    rows = spread(rows, "book_id", "chapter_seq")
    chapters = rows.select("book_id", F.col("chapter_seq").cast("long").alias("chapter_seq"), "file", "title", F.lit("").alias("toc_title"), F.array().cast("array<string>").alias("headings"))
    paragraphs = rows.select("book_id", F.col("chapter_seq").cast("long").alias("chapter_seq"), "file", F.col("title").alias("chapter"), F.posexplode(split_paragraphs(F.coalesce(F.col("text"), F.lit("")), nfkc)).alias("par", "text"))
    books = rows.groupBy("book_id").agg(F.min_by("file", "chapter_seq").alias("source_path")).withColumn("sha256", F.lit(""))
    return Tables(books, _empty(spark, METADATA), chapters, paragraphs, sentences_of(paragraphs), _empty(spark, RESOURCES), cut=True)


def from_sentences(spark: SparkSession, chapters: list[tuple], metadata: dict[str, str] | None = None, resources: list[tuple] | None = None, book_id: str = "book", source_path: str = "book.epub") -> Tables:
    """A small book given in memory: (file, title, [text, ...][, toc_title[, headings]]); one sentence to a paragraph."""
    chapter_rows = [(book_id, i, c[0], c[1], c[3] if len(c) > 3 else "", list(c[4]) if len(c) > 4 else []) for i, c in enumerate(chapters)]
    par_rows = [(book_id, i, c[0], c[1], p, t) for i, c in enumerate(chapters) for p, t in enumerate(c[2])]
    paragraphs = spark.createDataFrame(par_rows, PARAGRAPHS)
    sentences = paragraphs.withColumn("sent", F.lit(0)).withColumn("ord", reading_order(F.col("sent")))
    return Tables(
        spark.createDataFrame([(book_id, source_path, "")], BOOKS),
        spark.createDataFrame([(book_id, i, k, v) for i, (k, v) in enumerate((metadata or {}).items())], METADATA),
        spark.createDataFrame(chapter_rows, CHAPTERS),
        paragraphs,
        sentences,
        spark.createDataFrame([(book_id, i, *r) + (None,) * (8 - len(r)) for i, r in enumerate(resources or [])], RESOURCES),
    )
