"""Reports of many books: the five files of each, written on the executors by a data source of its own.

``report_rows`` makes one row for the head of a book's report and for each of its findings, chapters and resources;
``write_book_reports`` deals them by book, sorts them and hands them to the sink. A task holds one row at a time. Files are
staged beside their place and moved there when all tasks are done; a failed job leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillscan.plans.analyze import Analysis
from quillscan.plans.report import FIELDS, REDACTED, book_records, extracted_text, finding_records, page_end, page_start
from quillscan.plans.scoring import finding_counts

HEAD, FINDING, CHAPTER, RESOURCE = range(4)
ROWS = "book_id string, kind int, at struct<n:bigint,a:string,b:string,c:string,d:int,e:int,f:string,g:string>, value string"


def report_rows(analysis: Analysis, private: Collection[str] = ()) -> DataFrame:
    """Everything that the reports are made of, as JSON in the order in which it is written.

    Every path in ``private`` is replaced in all texts, longer ones first.
    """
    t = analysis.tables
    place = lambda n, *words: F.struct(n.cast("long").alias("n"), *[(w if w is not None else F.lit(None)).cast("int" if k in "de" else "string").alias(k) for k, w in zip("abcdefg", (*words, *[None] * (7 - len(words))))]).alias("at")
    rows = lambda df, kind, at, value: df.select("book_id", F.lit(kind).alias("kind"), at, value.alias("value"))
    text = lambda column: F.to_json(column, {"ignoreNullFields": "false"})
    counts = finding_counts(analysis.findings).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("\u001f", "by", "value").alias("k"), F.col("n").cast("long").alias("n"))))).alias("counts"))
    head = book_records(analysis).join(counts, "book_id", "left").select("book_id", F.struct("record", "counts").alias("head"))
    found = finding_records(analysis.findings)
    named = {c: F.col(c) for c in ("category", "file", "chapter", "paragraph", "sentence", "code", "id")}
    chapters = extracted_text(analysis).withColumnRenamed("title", "shown").join(t.chapters.select("book_id", "chapter_seq", "title", "toc_title", F.coalesce("headings", F.array().cast("array<string>")).alias("headings")), ["book_id", "chapter_seq"])
    resources = t.resources.drop("width", "height")
    out = rows(head, HEAD, place(F.lit(0)), text(F.col("head")))
    out = out.unionByName(rows(found, FINDING, place(F.lit(0), *named.values()), text(F.struct(*[F.col(c) for c in found.columns if c != "book_id"]))))
    out = out.unionByName(rows(chapters, CHAPTER, place(F.col("chapter_seq")), text(F.struct("file", "shown", "title", "toc_title", "headings", "paragraphs"))))
    out = out.unionByName(rows(resources, RESOURCE, place(F.col("res_seq")), text(F.struct(*[F.col(c) for c in resources.columns if c not in ("book_id", "res_seq")]))))
    for path in sorted(private, key=len, reverse=True):
        out = out.withColumn("value", F.replace("value", F.lit(json.dumps(path, ensure_ascii=False)[1:-1]), F.lit(REDACTED)))
    return out


def write_book_reports(analysis: Analysis, folder: str, private: Collection[str] = ()) -> None:
    """Write ``folder/<book>/`` for every book; a book that is there already is replaced."""
    spark = analysis.findings.sparkSession
    spark.dataSource.register(BookReports)
    rows = report_rows(analysis, private).repartition("book_id").sortWithinPartitions("book_id", "kind", "at")
    rows.write.format("book_reports").mode("append").option("path", folder).save()


def folder_name(book: str) -> str:
    """A name that any file system takes, different for different books."""
    name = quote(book, safe=" ")
    return name if len(name) <= 120 and name.strip(". ") else f"{name[:80].strip('. ')}-{sha256(book.encode()).hexdigest()[:16]}"


class BookReports(DataSource):
    """The sink ``book_reports``; its option ``path`` names a folder that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "book_reports"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("option path is missing")
        return BookReportsWriter(self.options["path"], uuid.uuid4().hex)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    books: list[str]


def _indented(value, depth: int) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2).replace("\n", "\n" + "  " * depth)


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).replace("</", "<\\/")


class _Book:
    """The open files of one book, fed row by row."""

    def __init__(self, files: fs.FileSystem, folder: str, head: dict):
        files.create_dir(folder)
        self.out = {name: files.open_output_stream(f"{folder}/{name}") for name in ("report.json", "metadata.json", "extracted_text.txt", "findings.csv", "report.html")}
        self.record, self.n = head["record"], [0, 0, 0, 0]
        counts: dict[str, dict[str, int]] = {by: {} for by in ("severity", "category", "chapter")}
        for key, n in (head["counts"] or {}).items():
            by, _, value = key.partition("\u001f")
            counts[by][value] = n
        self.counts, book = counts, self.record["book"]
        self.put("report.json", f'{{\n  "book": {_indented(book, 1)},\n  "category_scores": {_indented(self.record["category_scores"], 1)},\n  "findings": [')
        self.put("report.html", page_start(book["title"]) + f'{{"book":{_compact(book)},"category_counts":{_compact(counts["category"])},"category_scores":{_compact(self.record["category_scores"])},"chapter_counts":{_compact(counts["chapter"])},"findings":[')
        self.put("metadata.json", '{\n  "chapters": [')
        self.csv([FIELDS])

    def put(self, name: str, text: str) -> None:
        self.out[name].write(text.encode())

    def csv(self, rows: list[list]) -> None:
        text = io.StringIO(newline="")
        csv.writer(text).writerows(rows)
        self.put("findings.csv", text.getvalue())

    def add(self, kind: int, value: dict) -> None:
        if kind == RESOURCE and not self.n[RESOURCE]:
            self.close_chapters()
        first = not self.n[kind]
        self.n[kind] += 1
        if kind == FINDING:
            self.put("report.json", f"{'' if first else ','}\n    {_indented(value, 2)}")
            self.put("report.html", ("" if first else ",") + _compact(value))
            self.csv([["" if value[f] is None else value[f] for f in FIELDS]])
        elif kind == CHAPTER:
            paragraphs = value.pop("paragraphs")
            lines = [f"# {self.n[CHAPTER]}. {value.pop('shown')} ({value['file']})", *[p for p in paragraphs if p]]
            self.put("extracted_text.txt", ("" if first else "\n\n\n\n") + "\n\n".join(lines))
            self.put("metadata.json", f"{'' if first else ','}\n    {_indented(value | {'paragraph_count': len(paragraphs)}, 2)}")
        else:
            self.put("metadata.json", f"{'' if first else ','}\n    {_indented(value, 2)}")

    def close_chapters(self) -> None:
        self.put("metadata.json", ("\n  ]" if self.n[CHAPTER] else "]") + f',\n  "metadata": {_indented(self.record["book"]["metadata"], 1)},\n  "resources": [')

    def close(self) -> None:
        if not self.n[RESOURCE]:
            self.close_chapters()
        book, summary = self.record["book"], self.record["summary"]
        self.put("report.json", ("\n  ]" if self.n[FINDING] else "]") + f',\n  "summary": {_indented(summary, 1)}\n}}\n')
        self.put("report.html", f'],"severity_counts":{_compact(self.counts["severity"])},"summary":{_compact(summary)}}}' + page_end())
        self.put("metadata.json", ("\n  ]" if self.n[RESOURCE] else "]") + f',\n  "sha256": {_indented(book["sha256"], 1)},\n  "source_path": {_indented(book["source_file"], 1)}\n}}\n')
        self.put("extracted_text.txt", "\n")
        for stream in self.out.values():
            stream.close()


class BookReportsWriter(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def place(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def write(self, rows: Iterator) -> Staged:
        files, root = self.place()
        folder, books, name, book = f"{root}/.staging-{self.job}/{uuid.uuid4().hex}", [], None, None
        for row in rows:
            value = json.loads(row["value"])
            if row["kind"] == HEAD:
                if book:
                    book.close()
                name = row["book_id"]
                books.append(folder_name(name))
                book = _Book(files, f"{folder}/{books[-1]}", value)
            elif book is None or row["book_id"] != name:
                raise ValueError(f"book {row['book_id']!r} has rows but no head: rows must be sorted by book and kind")
            else:
                book.add(row["kind"], value)
        if book:
            book.close()
        return Staged(folder, books)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = self.place()
        for staged in filter(None, messages):
            for book in staged.books:
                if files.get_file_info(f"{root}/{book}").type != fs.FileType.NotFound:
                    files.delete_dir(f"{root}/{book}")
                files.move(f"{staged.folder}/{book}", f"{root}/{book}")
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        files, root = self.place()
        if files.get_file_info(f"{root}/.staging-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/.staging-{self.job}")
