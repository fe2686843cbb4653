"""Named queries over files, containers, reports and risk: inputs are made from the test tables as bytes, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.functions.text import percent
from quillscan.functions.udf import vectorized
from quillscan.operators import images, links, residue
from quillscan.plans import report, scoring
from quillscan.plans.analyze import Analysis, detected, fails
from quillscan.plans.queries import CITE_BASE, CITE_SQL, ORACLE_SQL, PLACE, QUERIES, SIGNALS, _meta, norm, query, seeded, shown
from quillscan.plans.rules import CATEGORIES, CATEGORY_WEIGHTS, load_rules
from quillscan.sources.files import from_epubs, from_files, read_epub, read_html
from quillscan.tables import Tables

__all__ = ["ORACLE_SQL", "QUERIES"]


def _docs(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")


def _escaped(text: str = "text"):
    out = F.col(text)
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


# Pages as they come: the head removed, block starts marked 1 and block ends 2, other tags as spaces.
# References end in a semicolon or, as these four may in HTML, without one where a page is cut.
PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', '\"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g')"
PAGES = rf"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<head>.*</head>', ''), '(?s)<!--.*?-->', '', 'g') AS body FROM pages),
 m AS (SELECT page_id, html, body, regexp_replace(regexp_replace(regexp_replace(body, '<(?:p|li)>', chr(1), 'g'), '</?(?:p|li|div|h1|article|nav|ul|footer|body|html)[^>]*>', chr(2), 'g'), '<[^>]*>', ' ', 'g') AS marked FROM b),
 c AS (SELECT *, list_filter(list_transform(regexp_extract_all(marked, '\x01([^\x01\x02]*)', 1), lambda x: {norm(PLAIN.format("x"))}), lambda x: x <> '') AS ps FROM m)
 SELECT page_id, len(ps)::INT AS paragraphs, md5(array_to_string(ps, chr(10))) AS digest, {norm(PLAIN.format("regexp_replace(regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')"))} AS heading,
 {norm(PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM c"""


@query("html_extract", PAGES, base=False)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", read_html(F.col("html").cast("binary"), F.lit("page.html")).alias("h"))
    of = lambda key: F.filter("h.metadata", lambda m: m["key"] == key)[0]["value"]
    return rows.select("page_id", F.size("h.paragraphs").alias("paragraphs"), F.md5(F.array_join("h.paragraphs", "\n").cast("binary")).alias("digest"), F.array_join("h.headings", "|").alias("heading"), of("title").alias("title"), of("language").alias("language"))


# Folders: one for each source, of pages and of texts in two encodings, with pictures of which some are referred to.

FILE_SQL = "lpad(doc_id::VARCHAR, 8, '0') || CASE WHEN doc_id % 3 = 0 THEN '.html' ELSE '.txt' END"


def _page(text="text"):
    i = F.col("doc_id").cast("string")
    kind = lambda n: (F.col("doc_id") % n).cast("string")
    return F.concat(
        F.lit("<html lang='l"), kind(5), F.lit("'><head><title>Page "), i, F.lit("</title><meta name='DC.Creator' content='W"), kind(9), F.lit("'></head><body><h2>Part "), kind(7),
        F.lit("</h2><p hidden>no</p><div style='display: none'><p>no</p></div><p>"), _escaped(text), F.lit("<ul><li>Item "), i, F.lit("</ul><script>no</script><img src='img/"), i, F.lit(".png' alt=' pic '><img src='https://x.org/a.png'></body>"),
    )


def _folder(spark, sf, encoded: bool = True) -> Tables:
    rows, i = _docs(spark, sf), F.col("doc_id")
    text = F.when((i % 3 == 2) & F.lit(encoded), F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    content = F.when(i % 3 == 0, F.encode(_page(), "UTF-8")).otherwise(text)
    files = rows.select(F.col("source").alias("book_id"), F.col("source").alias("source_path"), F.expr(FILE_SQL.replace("doc_id::VARCHAR", "string(doc_id)")).alias("file"), F.length(content).cast("long").alias("length"), content.alias("content"))
    picture = F.encode(F.concat(F.lit("picture "), (i % 50).cast("string")), "UTF-8")
    pictures = rows.where("doc_id % 2 = 0").select(F.col("source").alias("book_id"), F.concat(F.lit("img/"), i.cast("string"), F.lit(".png")).alias("file"), F.length(picture).cast("long").alias("length"), picture.alias("content"))
    return from_files(files, pictures)


TEXT_PARS = rf"list_filter(list_transform(string_split_regex(text, '(?:\r?\n){{2,}}'), lambda t: {norm('t')}), lambda t: t <> '')"
FOLDER_PARS = f"CASE WHEN doc_id % 3 = 0 THEN list_filter([{norm('text')}, 'Item ' || doc_id], lambda t: t <> '') ELSE {TEXT_PARS} END"


@query("folder_paragraphs", f"SELECT source AS book_id, {FILE_SQL} AS file, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id % 7 ELSE lpad(doc_id::VARCHAR, 8, '0') END AS chapter, len(ps)::INT AS paragraphs, md5(array_to_string(ps, chr(10))) AS digest FROM (SELECT *, {FOLDER_PARS} AS ps FROM documents) WHERE len(ps) > 0", base=False)
def _(spark, sf):
    rows = _folder(spark, sf).paragraphs.groupBy("book_id", "file", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda p: p["text"]).alias("ps"))
    return rows.select("book_id", "file", "chapter", F.size("ps").alias("paragraphs"), F.md5(F.array_join("ps", "\n").cast("binary")).alias("digest"))


@query("folder_metadata", f"""SELECT source AS book_id, key, arg_min(value, file) AS value FROM (SELECT source, {FILE_SQL} AS file, unnest(['title', 'language', 'creator']) AS key,
 unnest(CASE WHEN doc_id % 3 = 0 THEN ['Page ' || doc_id, 'l' || doc_id % 5, 'W' || doc_id % 9] ELSE [lpad(doc_id::VARCHAR, 8, '0'), NULL, NULL] END) AS value FROM documents) WHERE value IS NOT NULL GROUP BY 1, 2""", base=False)
def _(spark, sf):
    return _folder(spark, sf).metadata.select("book_id", "key", "value")


PAGE_SQL = "'<html lang=''l' || doc_id % 5 || '''><head><title>Page ' || doc_id || '</title><meta name=''DC.Creator'' content=''W' || doc_id % 9 || '''></head><body><h2>Part ' || doc_id % 7 || '</h2><p hidden>no</p><div style=''display: none''><p>no</p></div><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<ul><li>Item ' || doc_id || '</ul><script>no</script><img src=''img/' || doc_id || '.png'' alt='' pic ''><img src=''https://x.org/a.png''></body>'"


@query("folder_hash", f"SELECT source AS book_id, sha256(string_agg({FILE_SQL} || chr(0) || CASE WHEN doc_id % 3 = 0 THEN {PAGE_SQL} ELSE text END, '' ORDER BY {FILE_SQL})) AS sha256 FROM documents GROUP BY 1", base=False)
def _(spark, sf):
    return _folder(spark, sf, encoded=False).books.select("book_id", "sha256")


@query("folder_resources", "SELECT source AS book_id, 'img/' || doc_id || '.png' AS path, 'image/png' AS media_type, length('picture ' || doc_id % 50)::BIGINT AS size, sha256('picture ' || doc_id % 50) AS sha256, doc_id % 3 = 0 AS referenced, CASE WHEN doc_id % 3 = 0 THEN 'pic' END AS alt_text FROM documents WHERE doc_id % 2 = 0", base=False)
def _(spark, sf):
    return _folder(spark, sf).resources.select("book_id", "path", "media_type", "size", "sha256", "referenced", "alt_text")


# Containers: one for each document, six of eight broken in a way of their own.

_ROOT = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
_ITEMS = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="cover.png" media-type="image/png" properties="cover-image"/>'
ERRORS = ["EPUB is missing a valid mimetype declaration", "EPUB contains unsafe archive path: '../evil.txt'", "EPUB container.xml must not contain DTD or entity declarations", "EPUB OPF package is missing: OPS/book.opf", "Input is not a valid EPUB ZIP archive", "EPUB OPF package has no spine"]
ERROR_SQL = "CASE doc_id % 8 " + " ".join("WHEN {} THEN '{}'".format(n, e.replace("'", "''")) for n, e in enumerate(ERRORS)) + " END"


def _container(number: int, page: str) -> bytes:
    broken, out = number % 8, io.BytesIO()
    if broken == 4:
        return page.encode()
    spine = "" if broken == 5 else '<spine><itemref idref="b"/><itemref idref="a"/></spine>'
    package = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {number}</dc:title><dc:language>l{number % 5}</dc:language></metadata><manifest>{_ITEMS}</manifest>{spine}</package>'
    members = [
        ("mimetype", "" if broken == 0 else "application/epub+zip"), ("META-INF/container.xml", ("<!DOCTYPE x>" if broken == 2 else "") + _ROOT), ("OPS/book.opf", package),
        ("OPS/a.xhtml", f"<html><body><h1>First {number}</h1><p>{page}</p><img src='pic.png' alt='seen'/></body></html>"), ("OPS/b.xhtml", f"<html><body><p>Second {number}</p></body></html>"),
        ("OPS/cover.png", "cover"), ("OPS/pic.png", f"pic {number}"), ("OPS/no.png", "none"),
    ]
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members + [("../evil.txt", "x")] * (broken == 1):
            if not (broken == 3 and name.endswith(".opf")):
                archive.writestr(name, data)
    return out.getvalue()


@vectorized("binary")
def _packed(number: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([_container(int(n), p) for n, p in zip(number, page)])


def _containers(spark, sf) -> DataFrame:
    rows = _docs(spark, sf)
    return rows.select(F.col("doc_id").cast("string").alias("book_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".epub")).alias("source_path"), _packed(F.col("doc_id"), F.coalesce(_escaped(), F.lit(""))).alias("content"))


@query("epub_errors", f"SELECT doc_id::VARCHAR AS book_id, {ERROR_SQL} AS error FROM documents", base=False)
def _(spark, sf):
    return _containers(spark, sf).select("book_id", read_epub("content")["error"].alias("error"))


@query("epub_chapters", f"""SELECT book_id, chapter_seq::BIGINT AS chapter_seq, file, title, text, NULLIF(text, '') IS NOT NULL AS filled FROM (
 SELECT doc_id::VARCHAR AS book_id, 0 AS chapter_seq, 'OPS/b.xhtml' AS file, 'OPS/b.xhtml' AS title, md5('Second ' || doc_id) AS text FROM documents WHERE doc_id % 8 > 5
 UNION ALL SELECT doc_id::VARCHAR, 1, 'OPS/a.xhtml', 'First ' || doc_id, CASE WHEN {norm('text')} = '' THEN '' ELSE md5({norm('text')}) END FROM documents WHERE doc_id % 8 > 5)""", base=False)
def _(spark, sf):
    t = from_epubs(_containers(spark, sf), fail=False)
    texts = t.paragraphs.groupBy("book_id", "chapter_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda p: p["text"]).alias("ps"))
    text = F.coalesce(F.md5(F.array_join("ps", "\n").cast("binary")), F.lit(""))
    return t.chapters.join(texts, ["book_id", "chapter_seq"], "left").select("book_id", "chapter_seq", "file", "title", text.alias("text"), F.col("ps").isNotNull().alias("filled"))


@query("epub_metadata", "SELECT doc_id::VARCHAR AS book_id, unnest(['title', 'language']) AS key, unnest(['Book ' || doc_id, 'l' || doc_id % 5]) AS value FROM documents WHERE doc_id % 8 > 5", base=False)
def _(spark, sf):
    return from_epubs(_containers(spark, sf), fail=False).metadata.select("book_id", "key", "value")


@query("epub_images", """SELECT doc_id::VARCHAR AS book_id, 'OPS/' || name AS path, sha256(CASE name WHEN 'cover.png' THEN 'cover' WHEN 'pic.png' THEN 'pic ' || doc_id ELSE 'none' END) AS sha256, CASE WHEN name = 'cover.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type, name <> 'no.png' AS referenced, CASE WHEN name = 'pic.png' THEN 'seen' END AS alt_text
 FROM documents, (SELECT unnest(['cover.png', 'pic.png', 'no.png']) AS name) WHERE doc_id % 8 > 5""", base=False)
def _(spark, sf):
    t = from_epubs(_containers(spark, sf), fail=False)
    return t.resources.where("path like '%.png'").select("book_id", "path", "sha256", "media_type", "referenced", "alt_text")


@query("image_dimensions", "SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN (doc_id * 7 % 60000)::INT END AS width, CASE WHEN doc_id % 5 < 3 THEN (doc_id * 11 % 60000)::INT END AS height FROM documents", base=False)
def _(spark, sf):
    rows = _docs(spark, sf).select("doc_id", (F.col("doc_id") * 7 % 60000).alias("w"), (F.col("doc_id") * 11 % 60000).alias("h"))
    large = lambda c, n: F.lpad(F.hex(c), n, "0")
    small = lambda c: F.concat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), F.lpad(F.hex((F.col(c) / 256).cast("long")), 2, "0"))
    kinds = [F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), large("w", 8), large("h", 8)), F.concat(F.lit("474946383961"), small("w"), small("h")), F.concat(F.lit("FFD8FFE000040000FFC0001108"), large("h", 4), large("w", 4)), F.lit("89504E470D0A1A0A00"), F.lit("FFD8FFC0")]
    head = F.lit(None).cast("string")
    for n, kind in enumerate(kinds):
        head = F.when(F.col("doc_id") % 5 == n, kind).otherwise(head)
    return rows.select("doc_id", images.dimensions(F.unhex(head)).alias("d")).select("doc_id", "d.width", "d.height")


# Rules


@query("detector_switch", f", {CITE_BASE} SELECT code, count(*) AS n FROM ({CITE_SQL}) GROUP BY 1")
def _(spark, sf):
    rules = load_rules({"chatbot_residue": {"enabled": False}})
    return detected(seeded(spark, sf), rules, ("chatbot_residue", "citations")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("own_patterns", rf"SELECT book_id, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])readers?(?:$|[^\p{{L}}\p{{N}}_])') THEN 'audience' ELSE 'configured_phrase' END AS code, {PLACE}, 1.0::DOUBLE AS weight FROM sents WHERE regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])readers?(?:$|[^\p{{L}}\p{{N}}_])') OR contains(lower(text), '2021 it rained.')")
def _(spark, sf):
    return shown(residue.detect(seeded(spark, sf), {"chatbot_residue": {"patterns": [["audience", r"\breaders?\b", "Names its audience"]], "phrases": ["2021 IT rained."]}}))


def answered(url: str, timeout: float) -> tuple[int, str | None]:
    """Answers of a made-up net: some addresses are there, some are not, some move without saying where."""
    return ((200, None), (404, None), (302, None))[len(url) % 3]


@query("link_verification", rf""", u AS (SELECT book_id, sent_seq, file, par, sent, unnest(list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>\])}}]+'), lambda x, i: {{'x': x, 'i': i}})) AS u FROM sents),
 f AS (SELECT book_id, u.x AS url, min(struct_pack(s := sent_seq, i := u.i, file := file, par := par, sent := sent)) AS f FROM u GROUP BY 1, 2),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f.s, f.i) AS n FROM f) WHERE n <= 100 AND length(url) % 3 > 0)
 SELECT book_id, f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence, 'Link verification was requested and ' || url || CASE length(url) % 3 WHEN 1 THEN ' HTTP status 404' ELSE ' could not be safely completed' END || '; review the URL and its source context.' AS reason FROM k""")
def _(spark, sf):
    found = links.link_findings(seeded(spark, sf), load_rules(), answered)
    return found.select("book_id", "file", F.col("paragraph").cast("long").alias("paragraph"), F.col("sentence").cast("long").alias("sentence"), "reason")


# Addresses that may be asked (public, http or https, no user, usual ports) and others; names are resolved by a stub.
TARGETS = {
    "http://books.example.test/a": True, "https://8.8.8.8/": True, "http://inner.example.test/": False, "http://127.0.0.1/": False, "http://10.1.2.3:80/": False, "ftp://books.example.test/": False,
    "http://user@books.example.test/": False, "http://books.example.test:8080/": False, "http://localhost./": False, "http://[::1]/": False, "https://[2606:4700::1111]/": True, "http://0x7f.1/": False, "http:///none": False, "https://books.example.test:443/x": True,
}


def _resolved(host, port, type=None):
    return [(0, 0, 0, "", ("192.168.0.9" if host.startswith("inner") else "8.8.4.4", port))]


@query("url_safety", "SELECT doc_id, CASE doc_id % {} {} END AS safe FROM documents".format(len(TARGETS), " ".join(f"WHEN {n} THEN {safe}" for n, safe in enumerate(TARGETS.values()))), base=False)
def _(spark, sf):
    told = F.udf(lambda url: links.safe_target(url, _resolved) is not None, "boolean")
    url = F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("doc_id") % len(TARGETS) + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", told(url).alias("safe"))


@query("percentages", "SELECT doc_id, round_even(doc_id % 512 / 512.0::DOUBLE * 100, 0)::BIGINT || '%' AS whole, round_even(doc_id % 512 / 512.0::DOUBLE * 100, 1)::DECIMAL(9, 1) || '%' AS tenths FROM documents", base=False)
def _(spark, sf):
    ratio = F.col("doc_id") % 512 / 512.0
    return _docs(spark, sf).select("doc_id", percent(ratio).alias("whole"), percent(ratio, 1).alias("tenths"))


# Risk of books with findings of every severity, own weights and those of the severity.

RISK = f"""WITH cats AS (SELECT unnest({list(CATEGORIES)}) AS category, unnest({[CATEGORY_WEIGHTS[c] for c in CATEGORIES]})::DOUBLE AS cw, unnest(range({len(CATEGORIES)})) AS k),
 f AS (SELECT doc_id::VARCHAR AS book_id, category, (doc_id + k) % 4 + doc_id // 3 % 2 AS rank, CASE WHEN k % 2 = 0 THEN 0 ELSE doc_id % 11 END AS weight FROM documents, cats WHERE (doc_id + k) % 4 + doc_id // 3 % 2 > 0 AND doc_id % 6 > 0),
 s AS (SELECT d.doc_id::VARCHAR AS book_id, c.category, c.cw, least(100.0::DOUBLE, coalesce(sum(CASE WHEN f.weight > 0 THEN f.weight ELSE [1, 2, 4, 1][f.rank] END), 0) * 10.0::DOUBLE) AS score FROM documents d CROSS JOIN cats c LEFT JOIN f ON f.book_id = d.doc_id::VARCHAR AND f.category = c.category GROUP BY 1, 2, 3),
 t AS (SELECT book_id, round(sum(score * cw), 6) AS total FROM s GROUP BY 1), h AS (SELECT book_id, max(rank) AS top, count(*) AS n FROM f GROUP BY 1)"""


def _risk(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _docs(spark, sf)
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(c).alias("category")) for n, c in enumerate(CATEGORIES)]))
    rank = (F.col("doc_id") + F.col("c.k")) % 4 + F.floor(F.col("doc_id") / 3) % 2
    found = rows.where("doc_id % 6 > 0").select("doc_id", k.alias("c")).select(F.col("doc_id").cast("string").alias("book_id"), "c.category", rank.cast("int").alias("rank"), F.when(F.col("c.k") % 2 == 0, 0).otherwise(F.col("doc_id") % 11).cast("double").alias("weight")).where("rank > 0")
    found = found.select("book_id", "category", F.element_at(F.array(*map(F.lit, ["low", "Medium", "HIGH", "critical"])), F.col("rank")).alias("severity"), "weight")
    books = rows.select(F.col("doc_id").cast("string").alias("book_id"))
    scores = scoring.category_scores(found, books, load_rules())
    return found, scores, scoring.summaries(found, scores, books.withColumn("language", F.lit("en")), load_rules())


@query("severity_risk", f"""{RISK} SELECT t.book_id, coalesce(n, 0)::BIGINT AS finding_count, total AS overall_score, CASE WHEN total < 30 THEN '낮은 위험' WHEN total < 60 THEN '추가 자료 확인 필요' WHEN total < 80 THEN '사람 검토 필요' ELSE '우선 검토 필요' END AS risk_level,
 CASE coalesce(top, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS highest, {scoring.DISCLAIMER!r} AS disclaimer FROM t LEFT JOIN h USING (book_id)""", base=False)
def _(spark, sf):
    return _risk(spark, sf)[2].select("book_id", F.col("finding_count").cast("long").alias("finding_count"), F.round("overall_score", 6).alias("overall_score"), "risk_level", F.col("highest_finding_severity").alias("highest"), "disclaimer")


@query("fail_on", f"{RISK} SELECT t.book_id, coalesce(top, 0) >= 3 OR total >= 60 AS high, coalesce(top, 0) >= 4 OR total >= 80 AS critical, false AS never FROM t LEFT JOIN h USING (book_id)", base=False)
def _(spark, sf):
    summary = _risk(spark, sf)[2].withColumn("overall_score", F.round("overall_score", 6))
    out = fails(summary, "high").withColumnRenamed("fails", "high")
    for threshold in ("critical", "never"):
        out = out.join(fails(summary, threshold).withColumnRenamed("fails", threshold), "book_id")
    return out


# Reports as rows


def _report(spark, sf) -> Analysis:
    t = _meta(spark, sf)
    found, scores, summary = _risk(spark, sf)
    return Analysis(t, found, scores, summary)


@query("report_records", f"""{RISK.replace("WITH ", ", ", 1)}, w AS (SELECT chapter_seq, sum(len(regexp_extract_all(text, '[^ ]+'))) AS words FROM pars GROUP BY 1)
 SELECT doc_id::VARCHAR AS book_id, 'The Book' AS title, CASE WHEN doc_id % 3 <> 0 THEN 'A. Writer' WHEN doc_id % 4 = 0 THEN 'B. Writer' ELSE 'a. writer' END AS author, file AS source_file, 1::BIGINT AS chapter_count, 0::BIGINT AS resource_count, coalesce(words, 0)::BIGINT AS word_count, coalesce(n, 0)::BIGINT AS finding_count, round((SELECT score FROM s WHERE s.book_id = docs.doc_id::VARCHAR AND category = 'images'), 6) AS images
 FROM docs LEFT JOIN w ON w.chapter_seq = doc_id LEFT JOIN h ON h.book_id = doc_id::VARCHAR""")
def _(spark, sf):
    rows = report.book_records(_report(spark, sf))
    count = lambda name: F.col(f"record.{name}").cast("long").alias(name.split(".")[1])
    return rows.select("book_id", "record.book.title", "record.book.author", "record.book.source_file", count("book.chapter_count"), count("book.resource_count"), count("summary.word_count"), count("summary.finding_count"), F.round(F.element_at("record.category_scores", "images"), 6).alias("images"))


@query("report_text", "SELECT d.doc_id::VARCHAR AS book_id, d.file, CASE WHEN d.doc_id % 7 = 0 THEN 'The Book: Part One' ELSE d.title END AS title, count(p.text)::INT AS paragraphs, coalesce(md5(string_agg(p.text, chr(10) ORDER BY p.par)), md5('')) AS digest FROM docs d LEFT JOIN pars p ON p.chapter_seq = d.doc_id GROUP BY ALL")
def _(spark, sf):
    t = _meta(spark, sf)
    rows = report.extracted_text(Analysis(t, None, None, None))
    return rows.select("book_id", "file", "title", F.size("paragraphs").alias("paragraphs"), F.md5(F.array_join("paragraphs", "\n").cast("binary")).alias("digest"))


@query("report_findings", f"{SIGNALS} SELECT book_id, file, paragraph AS location_paragraph, sentence AS location_sentence, severity, category, code, weight FROM found")
def _(spark, sf):
    t = seeded(spark, sf)
    found = detected(t, load_rules(), ("chatbot_residue", "citations")).withColumn("id", F.lit(""))
    rows = report.finding_records(found)
    return rows.select("book_id", "location.file", F.col("location.paragraph").cast("long").alias("location_paragraph"), F.col("location.sentence").cast("long").alias("location_sentence"), "severity", "category", "code", "weight")
