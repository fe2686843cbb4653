"""Repeated wording: exact and similar sentences and paragraphs, and phrases of several tokens.

Reading order is part of the result (which occurrence is reported, and where a budget of comparisons ends), so it is
computed arithmetically: an ordinal for every pair and every phrase occurrence, never by the order of processing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions.text import casefold, percent, words
from quillscan.operators._findings import findings, setting, union
from quillscan.operators.repeats import maximal_repeats
from quillscan.operators.similarity import ordered_sets, similar_pairs
from quillscan.shared import settled
from quillscan.tables import FINDINGS, Tables, reading_order

ACTION = "Compare the occurrences and retain, vary, or remove intentional repetition."


def _budget(rules, name: str, default: int) -> int | None:
    """A budget of comparisons or occurrences; None where the rules set it to null, for no budget."""
    value = setting(rules, "repetition", name, default)
    if value is None:
        return None
    value = int(value)
    if value < 0:
        raise ValueError(f"{name} must be zero or greater")
    return value


def eligible(tables: Tables, minimum: int) -> tuple[DataFrame, DataFrame]:
    """Sentences and paragraphs of enough tokens, with their tokens, normal form and reading order."""
    w = words(casefold(F.col("text")))
    sentences = tables.sentences.select("book_id", "file", "chapter", "par", "sent", "ord", "text", w.alias("w"))
    paragraphs = tables.paragraphs.select("book_id", "file", "chapter", "par", F.lit(0).alias("sent"), reading_order(F.lit(0)).alias("ord"), "text", w.alias("w"))
    return tuple(rows.where(F.size("w") >= minimum).withColumn("norm", F.array_join("w", " ")) for rows in (sentences, paragraphs))


def exact(rows: DataFrame, label: str) -> DataFrame:
    """Every occurrence of a normal form but its first.

    Forms are counted by two hashes, and only repeated ones are joined back, so no text is sorted and most of it never moves.
    """
    key = ["book_id", "x", "y"]
    rows = rows.withColumns({"x": F.xxhash64("norm"), "y": F.xxhash64("norm", F.lit(1))})
    forms = rows.groupBy(*key).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.drop("norm", "w").join(forms, key).where(F.col("ord") != F.col("first"))
    return findings(again, "repetition", f"exact_{label}", "medium", f"Exact repeated {label}; first occurrence is elsewhere in the book.", ACTION, 1.0)


def _before(rows: DataFrame, size: Column) -> DataFrame:
    """(book_id, chapter_seq, n, before): the sum of ``size`` in every chapter, and in those before it; one row a chapter is sorted, no text."""
    sizes = rows.groupBy("book_id", F.col("ord.chapter_seq").alias("chapter_seq")).agg(F.sum(size).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.withColumn("before", so_far - F.col("n"))


def _within(rows: DataFrame, chapters: DataFrame, most: int) -> DataFrame:
    """``rows`` of the chapters before which fewer than ``most`` were counted."""
    few = chapters.where(F.col("before") < most).select(F.col("book_id").alias("book"), "chapter_seq")
    return rows.join(few, (F.col("book_id") == F.col("book")) & (F.col("ord.chapter_seq") == F.col("chapter_seq")), "left_semi")


def unique_forms(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` unique normal forms of each book, numbered from 0 in reading order; and each book's number of forms.

    Forms are told apart by two hashes; chapters that lie wholly beyond ``most`` are left out before any are sorted, and text is only read for the forms that are left.
    """
    firsts = rows.groupBy("book_id", F.xxhash64("norm").alias("x"), F.xxhash64("norm", F.lit(1)).alias("y")).agg(F.min("ord").alias("ord")).select("book_id", "ord")
    firsts = settled(firsts, "forms")
    chapters = settled(_before(firsts, F.lit(1)), "form-chapters")
    counts = chapters.groupBy("book_id").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    first = settled(_within(firsts, chapters, most).withColumn("r", place).where(F.col("r") <= most).withColumn("r", F.col("r") - 1), "first-forms")
    return settled(rows.select("book_id", "ord", "file", "chapter", "par", "sent", "text", "w").join(first, ["book_id", "ord"]), "told-forms"), counts


def similar(rows: DataFrame, label: str, threshold: float, budget: int) -> tuple[DataFrame, DataFrame]:
    """Similar pairs within the budget, and the books whose budget did not reach all pairs."""
    forms, counts = unique_forms(rows, budget + 1)
    capped = counts.where(F.col("n") * (F.col("n") - 1) / 2 > budget).select("book_id")
    before = F.col("i") * (F.col("n") - 1) - F.col("i") * (F.col("i") - 1) / 2
    left = forms.join(counts, "book_id").select("book_id", "n", F.col("r").alias("i"), F.size("w").alias("left_size"), F.array_distinct("w").alias("left_words")).where(before < budget)
    right = forms.select("book_id", F.col("r").alias("j"), "file", "chapter", "par", "sent", "text", F.size("w").alias("right_size"), F.array_distinct("w").alias("right_words"))
    near = F.abs(F.col("left_size") - F.col("right_size")) <= F.greatest(F.lit(2), F.floor(F.col("left_size") / 3))
    pairs = left.join(right, "book_id").where((F.col("i") < F.col("j")) & (before + F.col("j") - F.col("i") <= budget) & near)
    dice = 2 * F.size(F.array_intersect("left_words", "right_words")) / (F.size("left_words") + F.size("right_words"))
    pairs = pairs.withColumn("dice", dice).where(F.col("dice") >= threshold)
    reason = F.concat(F.lit(f"Similar {label} wording ("), percent(F.col("dice")), F.lit(" shared vocabulary)."))
    return findings(pairs, "repetition", f"similar_{label}", "medium", reason, ACTION, F.col("dice")), capped


def similar_all(rows: DataFrame, label: str, threshold: float) -> DataFrame:
    """Similar pairs of a book's unique normal forms, all of them; ``threshold`` must be above 0."""
    form = F.struct("ord", F.size("w").alias("tokens"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    forms = rows.groupBy("book_id", F.xxhash64("norm").alias("x"), F.xxhash64("norm", F.lit(1)).alias("y")).agg(F.min(form).alias("f")).select("book_id", "f.*")
    forms = ordered_sets(forms, "book_id", "ord", "w", "tokens")
    pairs = similar_pairs(forms, threshold)
    left = forms.select("book", F.col("key").alias("i"), F.col("tokens").alias("left_size"))
    right = forms.select("book", F.col("key").alias("j"), F.col("tokens").alias("right_size"))
    near = F.abs(F.col("left_size") - F.col("right_size")) <= F.greatest(F.lit(2), F.floor(F.col("left_size") / 3))
    told = pairs.join(left, ["book", "i"]).join(right, ["book", "j"]).where(near).select(F.col("book").alias("book_id"), F.col("j").alias("ord"), "dice")
    told = told.join(rows.select("book_id", "ord", "file", "chapter", "par", "sent", "text"), ["book_id", "ord"])
    reason = F.concat(F.lit(f"Similar {label} wording ("), percent(F.col("dice")), F.lit(" shared vocabulary)."))
    return findings(told, "repetition", f"similar_{label}", "medium", reason, ACTION, F.col("dice"))


def phrases_all(rows: DataFrame, low: int) -> DataFrame:
    """Maximal repeats in more than one sentence, at their last occurrence; of those that begin and end in the same two sentences the longest."""
    repeats = maximal_repeats(rows, low).where("first.ord <> last.ord")
    best = F.max_by(F.struct("width", "phrase"), F.struct("width", (-F.col("first.pos")).alias("early"), "phrase")).alias("p")
    told = repeats.groupBy("book_id", F.col("first.ord").alias("first"), F.col("last.ord").alias("ord")).agg(best).select("book_id", "ord", "p.*")
    told = told.join(rows.select("book_id", "ord", "file", "chapter", "par", "sent", "text"), ["book_id", "ord"])
    return findings(told, "repetition", F.concat(F.lit("ngram_"), F.col("width").cast("string")), "medium", _phrase_reason(), ACTION, 1.0)


def _phrase_reason():
    quote = F.when(F.instr("phrase", "'") > 0, F.concat(F.lit('"'), F.col("phrase"), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.col("phrase"), F.lit("'")))
    return F.concat(F.lit("Repeated "), F.col("width").cast("string"), F.lit("-token phrase: "), quote, F.lit("."))


def phrases(rows: DataFrame, low: int, high: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Phrases found in more than one sentence within the budget of occurrences, and the books beyond it."""
    count = lambda size: sum((F.greatest(size - k + 1, F.lit(0)) for k in range(low, high + 1)), F.lit(0))
    sized = rows.select("book_id", "file", "chapter", "par", "sent", "ord", "text", "w", count(F.size("w")).cast("long").alias("grams"))
    chapters = settled(_before(sized, F.col("grams")), "phrase-chapters")
    capped = chapters.groupBy("book_id").agg(F.sum("n").alias("n")).where(F.col("n") > budget).select("book_id")
    reading = Window.partitionBy("book_id").orderBy("ord")
    # every counted sentence has an occurrence at least, so sentences beyond the budget cannot matter
    within = _within(sized.where("grams > 0"), chapters, budget).withColumn("r", F.row_number().over(reading)).where(F.col("r") <= budget)
    within = within.withColumn("before", F.sum("grams").over(reading.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("grams")).where(F.col("before") < budget)
    none = F.array().cast("array<struct<width:int,phrase:string>>")

    def of_width(k: int):
        starts = F.sequence(F.lit(1), F.size("w") - k + 1)
        return F.when(F.size("w") >= k, F.transform(starts, lambda s: F.struct(F.lit(k).alias("width"), F.array_join(F.slice("w", s, k), " ").alias("phrase")))).otherwise(none)

    grams = F.flatten(F.array(*[of_width(k) for k in range(low, high + 1)]))
    occurrences = within.select("book_id", "r", F.posexplode(grams).alias("p", "g"), "before").select("book_id", "r", (F.col("before") + F.col("p") + 1).alias("o"), "g.width", "g.phrase").where(F.col("o") <= budget)
    firsts = F.slice(F.array_sort(F.collect_list(F.struct("o", "r"))), 1, 2)
    spread = occurrences.groupBy("book_id", "width", "phrase").agg(F.min("o").alias("first"), F.max_by("r", "o").alias("last"), F.min("r").alias("low"), F.max("r").alias("high"), firsts.alias("two")).where("low < high")
    pair = F.transform("two", lambda x: x["r"])
    spread = spread.withColumn("pair", F.array_sort(pair))
    once = F.row_number().over(Window.partitionBy("book_id", "pair").orderBy(F.desc("width"), "first"))
    told = spread.withColumn("nth", once).where("nth = 1").join(within.select("book_id", F.col("r").alias("last"), "file", "chapter", "par", "sent", "text"), ["book_id", "last"])
    return findings(told, "repetition", F.concat(F.lit("ngram_"), F.col("width").cast("string")), "medium", _phrase_reason(), ACTION, 1.0), capped


def detect(tables: Tables, rules=None) -> DataFrame:
    """All findings of repetition. A budget of null in the rules compares all pairs, or finds phrases of any width."""
    if not setting(rules, "repetition", "enabled", True):
        return tables.sentences.sparkSession.createDataFrame([], FINDINGS)
    minimum, threshold = int(setting(rules, "repetition", "minimum_tokens", 5)), float(setting(rules, "repetition", "similarity_threshold", 0.85))
    low, high = setting(rules, "repetition", "ngram_range", (3, 8))
    pairs, grams = _budget(rules, "max_sentence_pairs", 10_000), _budget(rules, "max_ngram_occurrences", 100_000)
    # cut and tokenised once, as every part reads them again
    kept = [settled(rows.drop("norm"), f"eligible-{label}") for label, rows in zip(("sentences", "paragraphs"), eligible(tables, minimum))]
    sentences, paragraphs = (rows.withColumn("norm", F.array_join("w", " ")) for rows in kept)
    found = [exact(sentences, "sentence"), exact(paragraphs, "paragraph")]
    firsts = sentences.withColumn("kind", F.lit(0)).unionByName(paragraphs.withColumn("kind", F.lit(1)))
    first = firsts.groupBy("book_id").agg(F.min(F.struct("kind", "ord", "file", "chapter", "par", "sent", "text")).alias("f")).select("book_id", "f.*")
    limit = lambda books, code, what, n: findings(first.join(books.distinct(), "book_id", "left_semi"), "repetition", code, "medium", f"{what} ({n}) was reached; {'similar-wording' if 'comparison' in code else 'repeated-phrase'} review may be incomplete.", ACTION, 1.0)
    if pairs is None:
        found += [similar_all(sentences, "sentence", threshold), similar_all(paragraphs, "paragraph", threshold)]
    else:
        similar_s, capped_s = similar(sentences, "sentence", threshold, pairs)
        similar_p, capped_p = similar(paragraphs, "paragraph", threshold, pairs)
        found += [similar_s, similar_p, limit(capped_s.union(capped_p), "similarity_comparison_cap_reached", "Similarity comparison limit", pairs)]
    if grams is None:
        found.append(phrases_all(sentences, int(low)))
    else:
        told, capped = phrases(sentences, int(low), int(high), grams)
        found += [told, limit(capped, "ngram_occurrence_cap_reached", "N-gram occurrence limit", grams)]
    return union(found)
