"""Report artefacts: five files for one book, and report rows for many."""

from __future__ import annotations

import csv
import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.functions.text import word_count
from quillscan.plans.analyze import Analysis
from quillscan.plans.post import ORDER
from quillscan.plans.scoring import finding_counts

FIELDS = ["id", "severity", "category", "code", "file", "chapter", "paragraph", "sentence", "excerpt", "reason", "review_action", "weight"]
FORMATS = ("json", "html", "all")
# Fixed value: what a private path is shown as.
REDACTED = "업로드한 파일"


def book_records(analysis: Analysis) -> DataFrame:
    """(book_id, record): everything of a book's report but its findings, as one struct."""
    t = analysis.tables
    entries = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    metadata = t.metadata.groupBy("book_id").agg(entries("key", "value").alias("m"))
    chapters = t.chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapter_count"))
    resources = t.resources.groupBy("book_id").agg(F.count(F.lit(1)).alias("resource_count"))
    words = t.paragraphs.groupBy("book_id").agg(F.sum(word_count(F.col("text"))).alias("word_count"))
    scores = analysis.category_scores.groupBy("book_id").agg(entries("category", "score").alias("category_scores"))
    rows = t.books
    for side in (metadata, chapters, resources, words, analysis.summary, scores):
        rows = rows.join(side, "book_id", "left")
    of = lambda key: F.coalesce(F.try_element_at("m", F.lit(key)), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    book = F.struct(
        of("title").alias("title"), F.coalesce(F.nullif(of("author"), F.lit("")), of("creator")).alias("author"), of("publisher").alias("publisher"), of("language").alias("language"),
        F.col("source_path").alias("source_file"), "sha256", F.coalesce("m", F.create_map().cast("map<string,string>")).alias("metadata"), zero("chapter_count"), zero("resource_count"),
    )
    summary = F.struct("finding_count", "overall_score", "risk_level", rows["language"].alias("language"), "link_verification", "highest_finding_severity", "disclaimer", F.col("overall_score").alias("risk_score"), zero("chapter_count"), zero("word_count"))
    return rows.select("book_id", F.struct(book.alias("book"), summary.alias("summary"), "category_scores").alias("record"))


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings with their public fields, the location also as a struct."""
    return findings.select("book_id", *FIELDS, F.struct("file", "chapter", "paragraph", "sentence").alias("location"))


def extracted_text(analysis: Analysis) -> DataFrame:
    """(book_id, chapter_seq, text): each chapter's heading line and paragraphs; chapters in order make the book's text."""
    t = analysis.tables
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("toc_title", F.lit("")), F.col("file"))
    paragraphs = t.paragraphs.groupBy("book_id", "chapter_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("par", "text"))), lambda p: p["text"]).alias("ps"))
    rows = t.chapters.join(paragraphs, ["book_id", "chapter_seq"], "left")
    return rows.select("book_id", "chapter_seq", F.col("file"), title.alias("title"), F.coalesce("ps", F.array().cast("array<string>")).alias("paragraphs"))


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in ranges of the report's order, each sorted: parts, one after another, are the sorted whole.

    A book is only split where it has more findings than a range; no task has more than its range.
    """
    return findings.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def write_corpus(analysis: Analysis, folder: str) -> dict[str, str]:
    """Reports of many books as tables: findings in order (Parquet, and CSV for readers without it), counts (Parquet), book records (JSON lines)."""
    found = in_order(analysis.findings)
    finding_records(found).write.mode("overwrite").parquet(f"{folder}/findings")
    found.select("book_id", *FIELDS).write.mode("overwrite").csv(f"{folder}/findings-csv", header=True, escape='"', quoteAll=False, lineSep="\r\n")
    finding_counts(analysis.findings).write.mode("overwrite").parquet(f"{folder}/counts")
    book_records(analysis).select("book_id", F.to_json("record").alias("value")).select("value").write.mode("overwrite").text(f"{folder}/books")
    return {name: f"{folder}/{name}" for name in ("findings", "findings-csv", "counts", "books")}


def record(analysis: Analysis) -> dict[str, Any]:
    """The report of one book as plain values; bounded by one book's limits, so it is gathered on the driver."""
    row = book_records(analysis).first()
    out = row["record"].asDict(recursive=True)
    found = [r.asDict(recursive=True) for r in finding_records(analysis.findings).orderBy(*ORDER).drop("book_id").toLocalIterator()]
    return out | {"findings": found}


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def render_html(report: dict[str, Any]) -> str:
    """A page of its own with the record as data, counts, and filters by category, severity and words."""
    data = dict(report)
    for name, key in (("severity_counts", lambda f: f["severity"]), ("category_counts", lambda f: f["category"]), ("chapter_counts", lambda f: f["chapter"] or f["file"])):
        counts: dict[str, int] = {}
        for f in report["findings"]:
            counts[key(f)] = counts.get(key(f), 0) + 1
        data[name] = dict(sorted(counts.items()))
    return page_start(report["book"]["title"]) + json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).replace("</", "<\\/") + page_end()


def page_start(title: str) -> str:
    """The page up to its data."""
    title = html.escape(title or "Review signals")
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;margin:2em}}td{{border-top:1px solid #ccc;vertical-align:top;padding:.3em}}</style></head>'
        f'<body><h1>{title}</h1><p id="score"></p><p id="note"></p><select id="category"><option value=""></option></select><select id="severity"><option value=""></option></select><input id="words">'
        '<table><tbody id="rows"></tbody></table><script type="application/json" id="data">'
    )


def page_end() -> str:
    """The page after its data."""
    script = (
        "const d=JSON.parse(document.getElementById('data').textContent),q=i=>document.getElementById(i);"
        "for(const [i,o] of [['category',d.category_counts],['severity',d.severity_counts]])for(const k in o)q(i).add(new Option(k+' ('+o[k]+')',k));"
        "function show(){const w=q('words').value.toLowerCase();q('rows').replaceChildren(...d.findings.filter(f=>(!q('category').value||f.category===q('category').value)"
        "&&(!q('severity').value||f.severity===q('severity').value)&&[f.excerpt,f.reason,f.review_action,f.chapter,f.file].join(' ').toLowerCase().includes(w))"
        ".map(f=>{const r=document.createElement('tr');for(const k of ['severity','category','code','file','chapter','paragraph','sentence','excerpt','reason','review_action'])r.insertCell().textContent=f[k];return r}))}"
        "for(const i of ['category','severity','words'])q(i).addEventListener('input',show);q('score').textContent=d.summary.overall_score.toFixed(1)+' '+d.summary.risk_level;q('note').textContent=d.summary.disclaimer;show();"
    )
    return f"</script><script>{script}</script></body></html>\n"


def write_reports(analysis: Analysis, folder: str | Path, format: str = "all") -> dict[str, Path]:
    """The five files of one book's report; every format writes them all."""
    if format not in FORMATS:
        raise ValueError("format must be 'json', 'html', or 'all'")
    where, report = Path(folder), record(analysis)
    where.mkdir(parents=True, exist_ok=True)
    chapters = extracted_text(analysis).orderBy("chapter_seq").collect()
    resources = [r.asDict() for r in analysis.tables.resources.orderBy("res_seq").drop("book_id", "res_seq", "width", "height").toLocalIterator()]
    heads = {r["chapter_seq"]: r for r in analysis.tables.chapters.collect()}
    inventory = [{"title": heads[c["chapter_seq"]]["title"], "file": c["file"], "toc_title": heads[c["chapter_seq"]]["toc_title"], "headings": list(heads[c["chapter_seq"]]["headings"] or []), "paragraph_count": len(c["paragraphs"])} for c in chapters]
    book = report["book"]
    chunks = [x for n, c in enumerate(chapters, 1) for x in (f"# {n}. {c['title']} ({c['file']})", *[p for p in c["paragraphs"] if p], "")]
    texts = {
        "report.json": _dump(report),
        "metadata.json": _dump({"metadata": book["metadata"], "source_path": book["source_file"], "sha256": book["sha256"], "chapters": inventory, "resources": resources}),
        "extracted_text.txt": "\n\n".join(chunks).rstrip() + "\n",
        "report.html": render_html(report),
    }
    paths = {name: where / name for name in (*texts, "findings.csv")}
    for name, text in texts.items():
        paths[name].write_text(text, encoding="utf-8")
    with paths["findings.csv"].open("w", encoding="utf-8", newline="") as stream:
        writer = csv.DictWriter(stream, FIELDS, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(report["findings"])
    return paths


def write_comparison(comparison: dict[str, Any], folder: str | Path, format: str = "all") -> None:
    where, text = Path(folder), _dump(comparison)
    where.mkdir(parents=True, exist_ok=True)
    if format in ("json", "all"):
        (where / "report.json").write_text(text, encoding="utf-8")
    if format in ("html", "all"):
        page = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Ebook comparison</title></head><body><h1>Ebook review-signal comparison</h1><pre>{html.escape(text)}</pre></body></html>\n'
        (where / "report.html").write_text(page, encoding="utf-8")


def redacted(value: Any, private: set[str]) -> Any:
    """The value with every private path, whole or inside a text, replaced; mappings and lists all the way down."""
    if isinstance(value, str):
        for path in sorted(private, key=len, reverse=True):
            value = value.replace(path, REDACTED)
        return value
    if isinstance(value, dict):
        return {k: redacted(v, private) for k, v in value.items()}
    return [redacted(v, private) for v in value] if isinstance(value, list) else value
