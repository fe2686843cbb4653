"""Named queries over what goes out and comes in as files: members of containers, and the files of reports read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillscan.operators import citations
from quillscan.plans import post, scoring
from quillscan.plans.analyze import Analysis
from quillscan.plans.queries import BASE, CITE_BASE, query, seeded
from quillscan.plans.rules import load_rules
from quillscan.plans.sink import write_book_reports
from quillscan.plans.source_queries import _containers
from quillscan.plans.wording_queries import CITED, HERE, ORACLE_SQL, QUERIES
from quillscan.shared import shared_folder
from quillscan.sources.archive import members

__all__ = ["ORACLE_SQL", "QUERIES"]

# Pages of the containers that the source queries pack; two of eight are no sound archives.
_PAGE = "'<html><body><h1>First ' || doc_id || '</h1><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><img src=''pic.png'' alt=''seen''/></body></html>'"


@query("container_members", f"""SELECT doc_id::VARCHAR AS book_id, 'OPS/a.xhtml' AS path, strlen({_PAGE})::BIGINT AS size, NULL::VARCHAR AS error, sha256({_PAGE}) AS sha256 FROM documents WHERE doc_id % 8 NOT IN (1, 4)
 UNION ALL SELECT doc_id::VARCHAR, 'OPS/b.xhtml', strlen('<html><body><p>Second ' || doc_id || '</p></body></html>'), NULL, sha256('<html><body><p>Second ' || doc_id || '</p></body></html>') FROM documents WHERE doc_id % 8 NOT IN (1, 4)
 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, CASE doc_id % 8 WHEN 1 THEN 'EPUB contains unsafe archive path: ''../evil.txt''' ELSE 'Input is not a valid EPUB ZIP archive' END, NULL FROM documents WHERE doc_id % 8 IN (1, 4)""", base=False)
def _(spark, sf):
    return members(_containers(spark, sf), "OPS/*.xhtml", contents=True).select("book_id", "path", "size", "error", F.sha2("content", 256).alias("sha256"))


_CITED = " UNION ALL ".join(f"SELECT book_id, '{s}' AS severity, '{c}' AS code, {HERE}, '{r}' AS reason FROM cited WHERE {when}" for c, s, when, r in CITED)
# Texts as the reader of the file gives them: an empty field is null.
_FILE = f"""WITH {BASE}, {CITE_BASE} SELECT book_id, left(sha256(concat_ws(chr(31), 'citations', code, file, chapter, par::VARCHAR, sent::VARCHAR, left(text, 300), reason)), 16) AS id, severity, 'citations' AS category, code, file, chapter, par::VARCHAR AS paragraph, sent::VARCHAR AS sentence,
 md5(left(text, 300)) AS excerpt, md5(reason) AS reason, 'Review the surrounding claim and add, correct, or document an appropriate source where needed.' AS review_action, '0.5' AS weight FROM ({_CITED})"""


@query("report_files", _FILE, base=False)
def _(spark, sf):
    """Reports of all books are written, and their tables of findings read back from the files."""
    t = seeded(spark, sf)
    found = post.identified(post.deduplicated(citations.detect(t)))
    scores = scoring.category_scores(found, t.books, load_rules())
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    write_book_reports(Analysis(t, found, scores, scoring.summaries(found, scores, t.books.select("book_id", F.lit("en").alias("language")), load_rules())), folder)
    names = ["id", "severity", "category", "code", "file", "chapter", "paragraph", "sentence", "excerpt", "reason", "review_action", "weight"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(f"{folder}/*/findings.csv", header=True, multiLine=True, escape='"', lineSep="\r\n")
    digest = lambda name: F.md5(F.col(name).cast("binary")).alias(name)
    return rows.select(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("book_id"), *[digest(n) if n in ("excerpt", "reason") else n for n in names])
