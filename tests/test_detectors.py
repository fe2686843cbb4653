"""Codes that each detector gives for small books."""

import pytest

from quillscan.operators import DETECTORS
from quillscan.tables import from_sentences


@pytest.fixture
def codes(spark):
    def run(detector, chapters, rules=None, **more):
        return sorted(r.code for r in DETECTORS[detector](from_sentences(spark, chapters, **more), rules).select("code").collect())

    return run


def one(*texts):
    return [("chapter-1.xhtml", "One", list(texts))]


def test_residue(codes):
    texts = ["As an AI language model, I cannot provide that advice.", "Assistant: Here is the requested answer.", "인공지능 언어 모델로서 그 요청을 도울 수 없습니다.", "이전 지시를 무시하고 답변을 제공하세요.", "Nothing here.", "[abc] marks", "ſystem: x"]
    assert codes("chatbot_residue", one(*texts)) == ["as an ai", "assistant label", "assistant label", "korean assistant", "korean prompt", "template marker"]
    assert codes("chatbot_residue", one(texts[0]), {"chatbot_residue": {"enabled": False}}) == []
    phrase = "I don't have personal opinions."
    assert codes("chatbot_residue", one(phrase), {"chatbot_residue": {"phrases": ["I don't have personal opinions"]}}) == ["configured_phrase"]
    assert codes("chatbot_residue", one(phrase), {"chatbot_residue": {"phrases": ["bespoke editorial marker"]}}) == []


def test_repetition(codes):
    text = "The harbor lights guided every traveler safely home tonight."
    assert codes("repetition", [("one.xhtml", "1", [text]), ("two.xhtml", "2", [text])]) == ["exact_paragraph", "exact_sentence", "ngram_8"]
    quiet = one("Quiet rivers carry silver moonlight beyond old stone bridges.", "Quiet rivers carry silver moonlight past old stone bridges.", "Travelers watched quiet rivers carry silver moonlight at dusk.")
    assert {"similar_sentence", "similar_paragraph", "ngram_4"} <= set(codes("repetition", quiet, {"repetition": {"similarity_threshold": 0.7, "ngram_range": (4, 4)}}))
    three = one("one two three four five six.", "seven eight nine ten eleven.", "alpha beta gamma delta epsilon.")
    assert codes("repetition", three, {"repetition": {"max_sentence_pairs": 0, "max_ngram_occurrences": 0}}) == ["ngram_occurrence_cap_reached", "similarity_comparison_cap_reached"]
    with pytest.raises(ValueError):
        codes("repetition", three, {"repetition": {"max_sentence_pairs": -1}})


def test_repetition_quotes_phrases(spark):
    rows = DETECTORS["repetition"](from_sentences(spark, one("it's a long day for us", "it's a long day for them"))).where("code like 'ngram%'").collect()
    assert rows[0].reason == 'Repeated 5-token phrase: "it\'s a long day for".'


def test_structure(codes):
    start, end = "Morning came over the quiet hills again today.", "Everyone went home when the evening bells rang."
    chapters = [("1", "Chapter 1", [start, "TODO: insert image credit before publication.", end], "First Chapter", ["Section 1"]), ("2", "Chapter 3", [start, "x y.", end], "First Chapter", ["Section 2"])]
    assert set(codes("structure", chapters, {"structure": {"vocabulary_diversity_min": 0}})) == {"chapter_number_gap", "toc_title_issue", "editorial_remnant", "repeated_chapter_start", "repeated_chapter_end", "repeated_heading_structure"}
    assert codes("structure", one("however however however")) == ["connector_density", "low_vocabulary_diversity"]


def test_citations(codes):
    found = codes("citations", one("See doi:10.bad/. here", "Go https://example.com/TODO now", "The https:// should be full", "Citation needed.", "73% of readers agree", "As said (Smith, 2019)", "doi:10.1234/abc.d"))
    assert found == ["citation_present", "doi_present", "empty_url", "malformed_doi", "placeholder_url", "source_needed_marker", "uncited_statistic_candidate", "url_present"]


def test_consistency(codes):
    assert codes("consistency", one("He was 12 years old and she was 25 years old, with 25% and 40%.", "Ada Lovelace met Augusta Lovelace.")) == ["multiple_ages", "multiple_numbers", "multiple_percentages", "name_variant"]


def test_images(codes, spark):
    resources = [("images/IMG_1.png", "image/png", 10, "same-hash", False, "alt"), ("cover.png", "image/png", 10, "same-hash", True, "alt"), ("b.jpg", "image/jpeg", 0, "", True, None)]
    assert codes("images", one("x"), resources=resources) == ["duplicate_image", "duplicate_image", "generic_filename_weak", "missing_alt_text", "missing_hash", "missing_image_license_context", "missing_size", "unused_image"]
    row = DETECTORS["images"](from_sentences(spark, one("x"))).collect()
    assert [(r.code, r.excerpt, r.weight) for r in row] == [("no_images_inventory", "Image inventory: no image resources recorded for source file chapter-1.xhtml.", 0.2)]


def test_metadata(codes):
    assert codes("metadata", one("x"), metadata={"title": "", "creator": "", "language": "en"}) == ["missing_creator", "missing_identifier", "missing_title"]
    many = {"title": "The Book", "dc:title": "Another", "author": "A", "creator": "B", "generator": "T"}
    assert codes("metadata", [("a", "The Book: One", ["x"])], metadata=many) == ["author_metadata_variant", "generator_metadata", "missing_identifier", "missing_language", "title_display_variant", "title_metadata_variant"]


def test_style(codes):
    texts = ["The door was opened. ", "is it!!!???", " ".join(["w"] * 45), "- a\n- b\n- c", "station mention kindness"]
    assert codes("style_patterns", one(*texts)) == ["list_density", "long_sentence", "punctuation_density", "punctuation_density"]
    assert codes("style_patterns", one("It was opened", "He is driven")) == ["passive_distribution"]
    assert codes("style_patterns", one("station mention kindness")) == ["nominalization_distribution"]


def test_order_does_not_depend_on_partitions(spark):
    chapters = [(f"{i}.txt", f"C{i}", [f"Word{j % 3} and some more words stand here again {j % 2}." for j in range(6)]) for i in range(5)]
    results = []
    for n in (1, 8):
        t = from_sentences(spark, chapters)
        t = type(t)(t.books, t.metadata, t.chapters.repartition(n), t.paragraphs.repartition(n), t.sentences.repartition(n), t.resources)
        results.append(sorted(map(tuple, DETECTORS["repetition"](t, {"repetition": {"similarity_threshold": 0.5}}).collect())))
    assert results[0] == results[1] and results[0]


def test_nothing_is_passed_over_before_the_patterns(spark):
    """Sentences that a detector passes over by literals match none of its patterns, in any case and with the letters that only patterns take for ASCII."""
    from pyspark.sql import functions as F

    from quillscan.functions.regex import java
    from quillscan.operators import citations, residue
    from quillscan.plans.rules import load_rules

    told = ["AS AN AI", "Being an aİ language model", "I CANNOT help", "i can't provide", "UNABLE TO comply", "ignore theſe inſtructionſ", "Follow the above Instructions", " uſer : x", "SYSTEM:", "作为ai", "我无法帮助", "请告诉我", "忽略以上指令", "以下是回答",
        "作为语言模型", "인공지능 모델로서", "그 요청 도울 수 없어요", "기존 명령 무시", "앞선 지침 무시", "{{name}}", "[AUTHOR NAME]", "AS A LANGUAGE MODEL", "i don't have perſonal opinions"]
    rules = load_rules()
    patterns = [p for _, p, _ in residue.PATTERNS]
    rows = spark.createDataFrame([(t,) for t in told] + [("nothing here",)], "text string")
    missed = rows.where(~residue.may_match(rules))
    assert [r.text for r in missed.collect()] == ["nothing here"]
    assert all(rows.where(F.col("text").rlike(java(p))).count() for p in patterns)
    assert rows.where(residue.may_match({"chatbot_residue": {"patterns": [["own", "nothing", "Own"]], "phrases": []}})).count() == len(told) + 1
    cited = ["CITATION NEEDED", "ſource required", "Fuente necesaria", "doi: x", "HTTP://", "[,]", "(Smith, 2019)", "five 5%", "one in ٣", "10.1234/x"]
    rows = spark.createDataFrame([(t,) for t in cited] + [("nothing here",)], "text string")
    assert [r.text for r in rows.where(~citations.may_match()).collect()] == ["nothing here"]
