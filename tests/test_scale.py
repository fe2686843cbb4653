"""Normalisation in the JVM, guards in the job that runs anyway, links by host and ordered output."""

import re
import sys
import unicodedata
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillscan.functions.text import casefold, normalize_text, split_paragraphs, unsure
from quillscan.operators import consistency, structure
from quillscan.operators.links import UNDONE, link_findings, outcomes
from quillscan.plans import post
from quillscan.plans.analyze import Analysis
from quillscan.plans.report import FIELDS, in_order, write_corpus
from quillscan.sources.files import Limits, from_files
from quillscan.tables import DEALT, from_sentences, from_texts, spread


@pytest.fixture(scope="module")
def characters(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    return spark.createDataFrame([(c, chr(c)) for c in codes], "c int, t string").repartition(4).persist()


def test_every_character_is_folded(characters):
    rows = characters.select("c", casefold(F.col("t")).alias("a"), casefold(F.concat(F.lit("Aß"), F.col("t"), F.lit("Σς"))).alias("b"))
    wrong = [r.c for r in rows.toLocalIterator() if r.a != chr(r.c).casefold() or r.b != f"Aß{chr(r.c)}Σς".casefold()]
    assert not wrong, [hex(c) for c in wrong[:20]]


def test_what_looks_normal_is_normal(spark, characters):
    found = {r.c for r in characters.where(F.col("t").rlike(unsure())).select("c").collect()}
    for code in range(sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000 and code not in found:
            char = chr(code)
            assert unicodedata.is_normalized("NFKC", char) and not unicodedata.combining(char), hex(code)
    # nothing that joins with a character before it is passed over
    bases = "aAeouяかは가나ᄀᄒଓণ"
    joined = {c for c in range(0x300, 0x20000) if not 0xD800 <= c < 0xE000 and any(not unicodedata.is_normalized("NFKC", b + chr(c)) for b in bases)}
    assert joined <= found and len(found) < 20_000
    texts = ["plain", "déjà vu", "déjà", "ﬁne Ａ①", "한글 한", "ẹ́", "’quoted’ – “text” …", "漢字　カナ ｶﾅ", None, ""]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(normalize_text(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts]


def test_limits_fail_the_job_that_reads(spark):
    rows = [("ok", "ok", f"{n}.txt", 6, b"A text") for n in range(3)] + [("big", "big", "x.txt", 60, b"B text")]
    files = spark.createDataFrame(rows, "book_id string, source_path string, file string, length long, content binary")
    read = lambda limits, **more: from_files(files.where(more.pop("where", "true")), limits=limits, **more).paragraphs.collect()
    assert len(read(Limits())) == len(read(None)) == 4
    for limits, what in ((Limits(file_bytes=50), "max-file-size .50 bytes.: big/x.txt"), (Limits(files=2), "2 supported files: ok"), (Limits(total_bytes=59), "59 total bytes: big")):
        with pytest.raises(Exception, match=what):
            read(limits)
        assert len(read(limits, where="book_id = 'none'")) == 0
    with pytest.raises(Exception, match="max-file-size"):
        read(Limits(file_bytes=50), title_from_metadata=True)
    texts = spark.createDataFrame([("b", 0, "f.txt", "t", "é" * 10)], "book_id string, chapter_seq long, file string, title string, text string")
    assert from_texts(texts, max_bytes=20).sentences.count() == 1
    with pytest.raises(Exception, match="Text exceeds 19 bytes: b/f.txt"):
        from_texts(texts, max_bytes=19).sentences.collect()


def test_a_url_is_asked_once(spark, tmp_path):
    def check(url, timeout):
        with open(f"{tmp_path}/asked", "a") as log:
            log.write(url + "\n")
        if url.startswith("http://moved"):
            return 301, "https://h1.org/there"
        return (404, None) if "gone" in url else (200, None)

    urls = [f"http://h{n % 3}.org/{'gone' if n % 5 == 0 else 'there'}{n}" for n in range(40)] + ["http://moved.org/a", "http:///none"]
    t = from_sentences(spark, [("a", "A", [f"See {u} and {u}" for u in urls])])
    t2 = from_sentences(spark, [("b", "B", [f"See {u} again" for u in urls])], book_id="second")
    both = type(t)(*[getattr(t, n).unionByName(getattr(t2, n)) for n in ("books", "metadata", "chapters", "paragraphs", "sentences", "resources")])
    found = link_findings(both, {}, check).select("book_id", "reason").collect()
    assert {r.book_id for r in found} == {"book", "second"} and len(found) == 16 and all("HTTP status 404" in r.reason for r in found)
    asked = (tmp_path / "asked").read_text().split("\n")
    assert sorted(u for u in asked if u and u != "https://h1.org/there") == sorted(urls)
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.detail for r in outcomes(rows, check=check, host_seconds=0.0).collect()} == {UNDONE}
    assert outcomes(rows.limit(0), check=check).count() == 0


def test_parts_of_the_corpus_report_are_in_order(spark, tmp_path):
    t = from_texts(spark.createDataFrame([(f"b{n % 3}", n, f"{n:02}.txt", "T", "See https://example.com/TODO now. About 7% are, \"so\" said." * (n % 4)) for n in range(40)], "book_id string, chapter_seq long, file string, title string, text string"))
    from quillscan.operators import citations
    from quillscan.plans import scoring
    from quillscan.plans.rules import load_rules

    found = post.identified(post.deduplicated(citations.detect(t)))
    want = [r.id for r in found.orderBy(*post.ORDER).select("id").collect()]
    assert [r.id for r in in_order(found).select("id").collect()] == want
    scores = scoring.category_scores(found, t.books, load_rules())
    languages = t.books.select("book_id", F.lit("en").alias("language"))
    write_corpus(Analysis(t, found, scores, scoring.summaries(found, scores, languages, load_rules())), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "findings-csv").glob("part-*"))
    import csv

    ids = [row["id"] for p in parts for row in csv.DictReader(p.open(newline="", encoding="utf-8"))]
    assert ids == want and csv.DictReader(parts[0].open(newline="")).fieldnames == ["book_id", *FIELDS]


BOOK = "book_id string, chapter_seq long, file string, title string, text string"


@pytest.mark.parametrize("operator, codes", [(consistency, ["multiple_ages", "multiple_dates"]), (consistency, ["multiple_percentages", "multiple_numbers"]), (structure, ["editorial_remnant"])])
def test_only_rows_that_are_found_are_cut_into_sentences(spark, operator, codes):
    """The paragraphs themselves give their first sentence: no join, and the text is read once."""
    texts = [
        "He was 12 years old. She was 25 Years Old, at 5% or 6 PERCENT.\n\nTODO later. On 1/2/2020 and May 3, 2021.", "3 AÑOS, 4 años. 1-2-03 y 4/5/2006", "Mayo 3,  2020 with junio 12 2021; draft note", "todos 1 year old", "待补充。 二",
        "lorem ipsum", "Insert  text", "ﬁrst ⅷ 2 yearſ old and 3 years old. TBD", "x", "", None, "12 a 13\n\n\n. ! xxx", "may 1 may 2 2020",
    ]
    t = from_texts(spark.createDataFrame([(str(n % 2), n, f"{n}.txt", "t", x) for n, x in enumerate(texts)], BOOK))
    found = operator.detect(t, only=codes)
    joined = operator.detect(replace(t, cut=False), only=codes)
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect())) and found.count() > 1
    # all codes together find the same as those asked for
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in operator.detect(t).collect() if r.code in codes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_white_space_is_collapsed_as_before(spark):
    texts = [" a  b\t\tc \n d", "a b", "\u00a0x\u2003 \u200b y\x1c\x00z ", "  ", "a\n b\n", "\x85a \x07", "q\ufeffr  s", ""]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r.x for r in rows.orderBy("n").select(normalize_text(F.col("t")).alias("x")).collect()]
    assert got == [" ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in unicodedata.normalize("NFKC", t)).split()) for t in texts]
    # a NUL is no paragraph's end, whether or not the text goes through Python
    parts = [r.x for r in spark.createDataFrame([(0, "a\x00b\n\nc"), (1, "é\n\nd")], "n int, t string").orderBy("n").select(split_paragraphs(F.col("t")).alias("x")).collect()]
    assert parts == [["a b", "c"], ["é", "d"]]


def test_parts_that_are_dealt_out_are_bounded(spark, monkeypatch):
    rows = spark.range(100_000).selectExpr("id", "repeat('x', 1000) AS text")
    monkeypatch.setattr("quillscan.tables.DEALT", 1 << 14)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert spread(rows, "id").rdd.getNumPartitions() == -(-size // (1 << 14)) > spark.sparkContext.defaultParallelism and DEALT < 128 << 20


def test_language_moves_no_text(spark):
    """The first 10,000 characters, in code points, sentences joined by one space; and only lengths are put in order."""
    texts = {"at": "😀" * 9_999 + "한", "beyond": "😀" * 10_000 + "한", "later": "b" * 5_000 + ". " + "c" * 4_996 + ". 한 글", "last": "b" * 5_000 + ". " + "c" * 4_997 + ". 한", "out": "b" * 5_000 + ". " + "c" * 4_998 + ". 한", "none": "x. y"}
    t = from_texts(spark.createDataFrame([(b, 0, "f", "t", x) for b, x in texts.items()], BOOK))
    told = post.resolve_language(t)
    assert {r.book_id: r.language for r in told.collect()} == {b: "ko" if re.search("[가-힣]", _joined(x)[:10_000]) else "en" for b, x in texts.items()}
    plan = told._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window [" in line]
    assert sorts and not any(re.search(r"\btext#", line) for line in sorts)


def _joined(text: str) -> str:
    return " ".join(re.split(r"(?<=[.!?])\s+", text))
