"""Registered queries against their SQL on the smallest test tables."""

import hashlib
import math
import os
from pathlib import Path

import duckdb
import pytest

from quillscan.plans.output_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = ["sentences", "residue_findings", "citation_signals", "repeated_ngrams", "similar_sentence", "overall_risk", "image_findings", "metadata_findings", "link_candidates",
    "compatible_text", "korean_sentences", "residue_asian", "passive_distribution", "list_density", "name_variant", "consistency_numbers", "repeated_heading_structure", "metadata_missing", "localized_findings", "language_resolution",
    "html_extract", "folder_paragraphs", "folder_metadata", "folder_hash", "folder_resources", "epub_errors", "epub_chapters", "epub_images", "image_dimensions", "link_verification", "url_safety", "severity_risk", "fail_on", "report_records", "report_text", "exact_sentence",
    "similar_sentence_all", "similar_paragraph_all", "repeated_5grams", "phrase_hits", "residue_phrase_list", "texts_citations", "texts_style", "texts_consistency", "texts_structure", "texts_images", "texts_metadata", "texts_repetition", "container_members", "report_files"]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=str)
    assert key(got.select(*columns).collect()) == key(want.fetchall())


def test_html_extract_of_cut_references(spark, tmp_path):
    """A title that is cut within a reference: HTML reads it without its semicolon, and so does the SQL."""
    pages = [(1, "u", '<html lang="en"><head><title>A &amp;&amp</title></head><body><h1>B &quot</h1><p>C &copy; &middot D &am</p></body></html>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["html_extract"])
    got = QUERIES["html_extract"](spark, str(tmp_path)).select(*[d[0] for d in want.description])
    assert [tuple(r) for r in got.collect()] == want.fetchall()
    assert got.first().title == "A &&" and got.first().heading == 'B "'


def test_epub_chapters_of_empty_texts(spark, tmp_path):
    """A page without a filled block gives its whole body, here its heading, as the reference does; a null text is an empty one."""
    rows = [(6, "", "s"), (7, " \n", "s"), (14, None, "s"), (15, "None", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["epub_chapters"](spark, str(tmp_path)).where("chapter_seq = 1")
    told = {int(r.book_id): (r.title, r.text, r.filled) for r in got.collect()}
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    assert told == {n: (f"First {n}", digest(f"First {n}" if n < 15 else "None"), True) for n in (6, 7, 14, 15)}
