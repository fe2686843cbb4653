"""Containers as rows, folders as digests, reports as files, and what is freed afterwards."""

import hashlib
import io
import json
import struct
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillscan.plans.analyze import analyze
from quillscan.plans.report import write_reports
from quillscan.plans.sink import FINDING, folder_name, report_rows, write_book_reports
from quillscan.sources import epub
from quillscan.sources.archive import members, register
from quillscan.sources.files import folder_digests, from_epubs, from_files, read_epub
from quillscan.tables import from_texts, spread

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}"/></rootfiles></container>'
HEAD = '<package xmlns="http://www.idpf.org/2007/opf"><metadata/>'
ITEM = '<item id="{0}" href="{0}.xhtml" media-type="application/xhtml+xml"/>'
PACKAGE = HEAD + f"<manifest>{ITEM.format('a')}</manifest><spine><itemref idref='a'/></spine></package>"


def packed(members=None, method=zipfile.ZIP_DEFLATED, kind=zipfile.ZIP_STORED, **files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        content = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER.format("b.opf"), "b.opf": PACKAGE, "a.xhtml": "<p>One.</p>"} | files | (members or {})
        for name, data in content.items():
            if data is not None:
                z.writestr(name, data, kind if name == "mimetype" else method)
    return out.getvalue()


def changed(data, mark, offset, form, value):
    out, at = bytearray(data), data.rfind(mark)
    struct.pack_into(form, out, at + offset, value)
    return bytes(out)


def far(data, place=None, mark=b"PK\x06\x06", length=44, told=None):
    """The same archive with a 64-bit end record."""
    at = data.rfind(b"PK\x05\x06")
    n, size, offset = struct.unpack_from("<HLL", data, at + 10)
    record = struct.pack("<4sQ2H2L4Q", mark, length, 45, 45, 0, 0, n, told or n, size, offset)
    return data[:at] + record + struct.pack("<4sLQL", b"PK\x06\x07", 0, at if place is None else place, 1) + data[at:]


def twice():
    out = io.BytesIO(packed())
    with zipfile.ZipFile(out, "a") as z, pytest.warns(UserWarning):
        z.writestr("a.xhtml", "again")
    return out.getvalue()


def cases():
    sound, end, head = packed(), b"PK\x05\x06", b"PK\x01\x02"
    directory = struct.unpack_from("<L", sound, sound.rfind(end) + 16)[0]
    yield sound, None
    yield far(sound), None
    yield b"", "Input is not a valid EPUB ZIP archive"
    yield b"no archive", "Input is not a valid EPUB ZIP archive"
    yield sound + b"tail", "malformed or truncated end-of-central-directory record"
    yield sound[:-2], "malformed or truncated end-of-central-directory record"
    yield far(sound, place=len(sound) * 9), "truncated ZIP64"
    yield far(sound, mark=b"PK\x00\x00"), "malformed ZIP64"
    yield far(sound, length=1), "malformed ZIP64"
    yield far(sound, length=10**6), "malformed ZIP64"
    yield far(sound, told=epub.MEMBERS + 1), "too many archive members"
    yield changed(sound, end, 10, "<H", 0xFFFF), "missing its ZIP64"
    yield changed(sound, end, 12, "<L", 0xFFFFFFFF), "missing its ZIP64"
    yield changed(sound, end, 10, "<H", epub.MEMBERS + 1), "too many archive members"
    yield changed(sound, end, 12, "<L", epub.DIRECTORY_BYTES + 1), "central directory is too large"
    yield changed(sound, end, 16, "<L", len(sound)), "invalid central-directory range"
    yield changed(sound, end, 12, "<L", len(sound) - directory - 22 - 30), "truncated central-directory header"
    yield changed(sound, head, 0, "<L", 7), "malformed central-directory header"
    yield changed(sound, head, 28, "<H", 60_000), "malformed central-directory header length"
    yield changed(sound, end, 10, "<H", 3), "mismatched central-directory member count"
    yield packed({"../x": "x"}), "unsafe archive path: '../x'"
    yield packed({"/x": "x"}), "unsafe archive path: '/x'"
    yield twice(), "duplicate archive path: a.xhtml"
    yield changed(sound, head, 8, "<H", 1), "encrypted entry: a.xhtml"
    yield changed(sound, head, 24, "<L", epub.ENTRY_BYTES + 1), "exceeds safe size limit: a.xhtml"
    yield packed({"big": b"0" * 10**6}), "suspicious compression ratio: big"
    yield packed(mimetype=None), "missing a valid mimetype declaration"
    yield packed(kind=zipfile.ZIP_DEFLATED), "missing a valid mimetype declaration"
    yield packed({"META-INF/container.xml": None}), "missing META-INF/container.xml"
    yield packed({"META-INF/container.xml": "<!DOCTYPE a>" + CONTAINER}), "container.xml must not contain DTD"
    yield packed({"META-INF/container.xml": "<a>"}), "invalid container.xml"
    yield packed({"META-INF/container.xml": "<a/>"}), "does not identify an OPF package"
    yield packed({"META-INF/container.xml": CONTAINER.format("../b.opf")}), "unsafe archive path: '../b.opf'"
    yield packed({"b.opf": None}), "OPF package is missing: b.opf"
    yield packed({"b.opf": "<!ENTITY x>" + PACKAGE}), "OPF package must not contain DTD"
    yield packed({"b.opf": HEAD + "<spine/></package>"}), "has no manifest"
    yield packed({"b.opf": HEAD + f"<manifest>{ITEM.format('a')}</manifest></package>"}), "has no spine"
    yield packed({"b.opf": PACKAGE.replace("a.xhtml", "../../up.xhtml")}), "unsafe archive path"
    yield packed({"b.opf": HEAD + "<manifest>" + "".join(ITEM.format(f"i{n}") for n in range(epub.MANIFEST + 1)) + "</manifest><spine/></package>"}), "too many manifest items"
    yield packed({"b.opf": PACKAGE.replace("<itemref idref='a'/>", "<itemref idref='a'/>" * (epub.SPINE + 1))}, method=zipfile.ZIP_STORED), "too many spine items"
    yield packed({f"r{n}": "" for n in range(epub.RESOURCES)}), "too many packaged resources"


def test_every_way_to_break_a_container(spark):
    rows = [(str(n), data, message) for n, (data, message) in enumerate(cases())]
    got = {r.book_id: r.error for r in spark.createDataFrame([r[:2] for r in rows], "book_id string, content binary").select("book_id", read_epub("content")["error"].alias("error")).collect()}
    for book, _, message in rows:
        assert got[book] is None if message is None else message in (got[book] or ""), (book, message, got[book])
    assert len(rows) > 40


def test_members_are_read_only_where_asked_for(spark):
    bad = packed({"pics/x.png": b"picture" * 9, "a.xhtml": "<p>Fine.</p>"}, method=zipfile.ZIP_STORED).replace(b"picturepicture", b"picturePICTURE")
    files = spark.createDataFrame([("b", bad), ("none", None), ("junk", b"junk"), ("empty", b"")], "book_id string, content binary")
    listed = members(files)
    assert listed.columns == ["book_id", "path", "size", "packed", "error"]
    assert {(r.path, r.size) for r in listed.where("book_id = 'b'").collect()} == {("mimetype", 20), ("META-INF/container.xml", len(CONTAINER.format("b.opf"))), ("b.opf", len(PACKAGE)), ("a.xhtml", 12), ("pics/x.png", 63)}
    # the broken picture hurts only those who read it
    assert [bytes(r.content) for r in members(files, "*.xhtml", contents=True).where("book_id = 'b'").collect()] == [b"<p>Fine.</p>"]
    assert "Bad CRC" in members(files, "pics/*", contents=True).where("book_id = 'b'").first().error
    assert {r.book_id for r in listed.where("error is not null").collect()} == {"junk", "empty"}
    register(spark)
    files.createOrReplaceTempView("container_files")
    told = spark.sql("SELECT f.book_id, m.path FROM container_files f, LATERAL archive_members(f.content, '*.opf', false) m WHERE m.error IS NULL")
    assert [tuple(r) for r in told.collect()] == [("b", "b.opf")]


def test_a_member_that_cannot_be_read(spark):
    bad = packed({"a.xhtml": "<p>picturepicture.</p>"}, method=zipfile.ZIP_STORED).replace(b"picturepicture", b"picturePICTURE")
    files = spark.createDataFrame([("bad", "bad.epub", bad), ("good", "good.epub", packed())], "book_id string, source_path string, content binary")
    with pytest.raises(ValueError, match="Unable to read EPUB safely"):
        from_epubs(files)
    t = from_epubs(files, fail=False)
    assert [r.book_id for r in t.books.collect()] == ["good"] and {r.text for r in t.paragraphs.collect()} == {"One."}
    t.unpersist()


def test_folder_digests(spark):
    rows = [("x", f"{n:03}.txt", bytes([n % 256]) * (n * 50)) for n in range(300)] + [("y", "b", b""), ("y", "a", None)]
    got = {r.book_id: r.sha256 for r in folder_digests(spark.createDataFrame(rows, "book_id string, file string, content binary").repartition(5)).collect()}
    want = {}
    for book, name, data in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(book, hashlib.sha256()).update(name.encode() + b"\0" + (data or b""))
    assert got == {k: v.hexdigest() for k, v in want.items()}
    assert folder_digests(spark.createDataFrame([], "book_id string, file string, content binary")).count() == 0


def test_chapters_are_numbered_by_name(spark):
    files = spark.createDataFrame([("k", "k", f"{n}.txt", 1, f"Text {n}.".encode()) for n in (10, 9, 1)], "book_id string, source_path string, file string, length long, content binary")
    t = from_files(files)
    assert [(r.chapter_seq, r.file) for r in t.chapters.orderBy("chapter_seq").collect()] == [(0, "1.txt"), (1, "10.txt"), (2, "9.txt")]
    t.unpersist()


def books(spark):
    rows = [("one", 0, "a.txt", "A", "As an AI language model I write. See https://example.com/TODO now."), ("one", 1, "b, \"c\".txt", "B", "First.\n\nSecond </script> ones.\n\n한국어 문장."), ("t/wo", 0, "/secret/place/x.txt", "", ""), ("three", 0, "c.txt", "C", "The same long line stands here twice. " * 2)]
    return from_texts(spark.createDataFrame(rows, "book_id string, chapter_seq long, file string, title string, text string"))


def test_reports_are_written_by_the_executors(spark, tmp_path):
    t = books(spark)
    pictures = spark.createDataFrame([("one", 1, "p.png", "image/png", 5, "ab", True, "x", 3, 4), ("one", 0, "o.png", "image/png", 5, "", False, None, None, None)], t.resources.schema)
    t = replace(t, resources=pictures, metadata=spark.createDataFrame([("one", 0, "title", "T & co"), ("one", 1, "author", "Z")], t.metadata.schema))
    done = analyze(t)
    write_book_reports(done, f"file://{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").iterdir()} == {folder_name(b) for b in ("one", "t/wo", "three")}
    for book in ("one", "t/wo"):
        only = lambda df: df.where(F.col("book_id") == book)
        own = replace(done, tables=replace(t, **{n: only(getattr(t, n)) for n in ("books", "metadata", "chapters", "paragraphs", "sentences", "resources")}), findings=only(done.findings), category_scores=only(done.category_scores), summary=only(done.summary))
        for name, path in write_reports(own, tmp_path / "single").items():
            assert (tmp_path / "out" / folder_name(book) / name).read_bytes() == path.read_bytes(), (book, name)
    # again, over what is there, and without private paths
    write_book_reports(done, f"file://{tmp_path}/out", private=["/secret/place", "/secret/place/x.txt"])
    texts = [p.read_text() for p in (tmp_path / "out" / folder_name("t/wo")).iterdir()]
    assert not any("secret" in x for x in texts) and json.loads((tmp_path / "out" / folder_name("t/wo") / "report.json").read_text())["book"]["source_file"] == "업로드한 파일"
    done.release()


def test_a_failed_report_job_leaves_nothing(spark, tmp_path):
    from quillscan.plans.sink import BookReports

    done = analyze(books(spark))
    rows = report_rows(done)
    spark.dataSource.register(BookReports)
    headless = rows.where((F.col("book_id") != "three") | (F.col("kind") == FINDING)).repartition("book_id").sortWithinPartitions("book_id", "kind", "at")
    with pytest.raises(Exception, match="no head"):
        headless.write.format("book_reports").mode("append").option("path", f"file://{tmp_path}/out").save()
    assert not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="path"):
        rows.write.format("book_reports").mode("append").save()
    done.release()


def test_nothing_is_run_or_kept(spark, tmp_path):
    from quillscan.streaming.ingest import analyze_stream

    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("planning", "")
    rows = spark.range(50).groupBy((F.col("id") % 5).alias("k")).agg(F.count("*").alias("n"))
    from_texts(rows.select(F.col("k").cast("string").alias("book_id"), F.col("k").alias("chapter_seq"), F.lit("f").alias("file"), F.lit("t").alias("title"), F.col("n").cast("string").alias("text")))
    assert spread(rows).columns == rows.columns and not tracker.getJobIdsForGroup("planning")
    sc.setLocalProperty("spark.jobGroup.id", None)
    spark.catalog.clearCache()
    (tmp_path / "in").mkdir()
    for n in range(10):
        (tmp_path / "in" / f"{n}.txt").write_text(f"As an AI I write {n}.")
    seen = []
    read = lambda done, number: seen.append((number, done.tables.sentences.count(), done.findings.where("code = 'as an ai'").count() if number == 0 else 1))
    analyze_stream(spark, f"file://{tmp_path}/in", str(tmp_path / "out"), str(tmp_path / "ck"), sink=read, files_a_batch=1).awaitTermination()
    assert seen == [(n, 1, 1) for n in range(10)]
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_containers_are_opened_once(spark, tmp_path, monkeypatch):
    """However many tables are read, a container is opened by one job; a member that turns out to be broken leaves the book out."""
    import zipfile

    from quillscan.plans.source_queries import _container

    good, torn = _container(6, "One &amp; two"), bytearray(_container(7, "Three"))
    with zipfile.ZipFile(io.BytesIO(bytes(torn))) as archive:
        place = bytes(torn).index(b"pic 7")
        assert archive.testzip() is None
    torn[place] ^= 1
    opened = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    schema = "book_id string, source_path string, content binary"
    files = spark.createDataFrame([("good", "g.epub", good), ("torn", "t.epub", bytes(torn)), ("no", "n.epub", b"no"), ("none", "0.epub", None)], schema).mapInArrow(counted, schema)
    t = from_epubs(files, fail=False)
    assert [r.book_id for r in t.books.collect()] == ["good"] and t.books.first().sha256 == hashlib.sha256(good).hexdigest()
    assert [(r.chapter_seq, r.text) for r in t.paragraphs.orderBy("chapter_seq", "par").collect()] == [(0, "Second 6"), (1, "One & two")]
    assert {r.path for r in t.resources.collect()} >= {"OPS/pic.png", "OPS/no.png"} and {r.book_id for r in t.resources.collect()} == {"good"}
    assert t.metadata.count() == 2 and opened.value == 4
    with pytest.raises(ValueError, match="(t|n|0).epub"):
        from_epubs(files)
