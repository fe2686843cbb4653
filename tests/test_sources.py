import hashlib
import json
import zipfile

import pytest

from quillscan.cli import main
from quillscan.operators.images import dimensions_of
from quillscan.operators.links import candidates, outcome, safe_target
from quillscan.sources import epub, markup
from quillscan.sources.files import parse_source, read_text_safely, safe_upload_path
from quillscan.tables import from_sentences

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
PACKAGE = (
    '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Bk</dc:title><meta name="cover" content="c"/></metadata><manifest>'
    '<item id="a" href="first.xhtml" media-type="application/xhtml+xml"/><item id="b" href="second.xhtml" media-type="application/xhtml+xml"/><item id="c" href="cover.png" media-type="image/png"/></manifest>'
    '<spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
)


def make_epub(path, extra=(), package=PACKAGE):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/book.opf", package)
        for n in ("first", "second"):
            z.writestr(f"OPS/{n}.xhtml", f"<html><body><h1>{n} title</h1><p>Some {n} text.</p><img src='pic.png' alt=' '></body></html>")
        for name, data in (("OPS/cover.png", b"x"), ("OPS/pic.png", b"y"), ("OPS/no.png", b"z"), *extra):
            z.writestr(name, data)
    return path


def test_hidden_markup_and_broken_tags():
    text = "<html><body><h1>Visible heading</h1><p>Visible English sentence. 한국어 문장입니다.</p><p hidden>no</p><div aria-hidden='TRUE'><p>no</p></div><p style='display: none'>no</p><script>no</script><p style='visibility:hidden'>no</body>"
    assert markup.content(text) == (["Visible heading"], ["Visible English sentence. 한국어 문장입니다."])
    assert markup.content("<p><b>one<br>two<p>three<ul><li>a<li>b</ul>")[1] == ["one two", "three", "a", "b"]
    assert markup.content("<div>only text</div>")[1] == ["only text"]
    refs = markup.references("<picture><source srcset='a.png 1x, b.png 2x'><img src=c.png alt='x'></picture><svg><image xlink:href='d.svg'/></svg><object data=e.png></object><p style=\"background:url('f.png')\">")
    assert [r for r, _ in refs] == ["a.png", "b.png", "c.png", "d.svg", "e.png", "f.png"]
    assert markup.resolved("../x.png", "a/b.html") == "x.png" and markup.resolved("../../x.png", "a/b.html") is None


def test_directory(spark, tmp_path):
    book = tmp_path / "book"
    (book / "nested").mkdir(parents=True)
    (book / "z.html").write_text("<html lang=ko><head><title>T</title><meta name=author content='A B'></head><body><h1>Head</h1><p>One.</p><img src='i.png' alt='x'></body></html>")
    (book / "nested" / "a b+.txt").write_text("First paragraph.\n\n둘째 문장입니다. English follows.", encoding="utf-8")
    (book / "ignore.bin").write_bytes(b"x")
    (book / "i.png").write_bytes(b"i")
    (book / "unused.png").write_bytes(b"u")
    t = parse_source(spark, book)
    assert [(r.file, r.title) for r in t.chapters.orderBy("chapter_seq").collect()] == [("nested/a b+.txt", "a b+"), ("z.html", "Head")]
    assert [(r.par, r.sent) for r in t.sentences.where("chapter_seq = 0").orderBy("ord").collect()] == [(0, 0), (1, 0), (1, 1)]
    assert {r.key: r.value for r in t.metadata.collect()} == {"title": "a b+", "language": "ko", "author": "A B"}
    assert [(r.path, r.referenced, r.alt_text) for r in t.resources.orderBy("path").collect()] == [("i.png", True, "x"), ("unused.png", False, None)]
    digest = hashlib.sha256()
    for name in ("nested/a b+.txt", "z.html"):
        digest.update(name.encode() + b"\0" + (book / name).read_bytes())
    assert t.books.first().sha256 == digest.hexdigest()
    with pytest.raises(ValueError, match="max-file-size"):
        parse_source(spark, book, 5)


def test_epub(spark, tmp_path):
    t = parse_source(spark, make_epub(tmp_path / "b.epub"))
    assert [r.title for r in t.chapters.orderBy("chapter_seq").collect()] == ["second title", "first title"]
    assert {r.path: (r.referenced, r.alt_text) for r in t.resources.collect()} == {"OPS/first.xhtml": (True, None), "OPS/second.xhtml": (True, None), "OPS/cover.png": (True, None), "OPS/pic.png": (True, None), "OPS/no.png": (False, None)}
    assert [(r.key, r.value) for r in t.metadata.collect()] == [("title", "Bk")]


def test_bad_epubs(spark, tmp_path):
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    with pytest.raises(ValueError, match="valid EPUB ZIP archive"):
        parse_source(spark, tmp_path / "bad.epub")
    for extra, what in (((("../outside.xhtml", b"x"),), "unsafe archive path"), ((("OPS/big.txt", b"0" * 250_000),), "suspicious compression ratio")):
        with pytest.raises(ValueError, match=what):
            epub.read(make_epub(tmp_path / "x.epub", extra).read_bytes())
    with pytest.raises(ValueError, match="DTD"):
        epub.read(make_epub(tmp_path / "x.epub", package="<!DOCTYPE x>" + PACKAGE).read_bytes())
    data = bytearray(make_epub(tmp_path / "x.epub").read_bytes())
    at = data.rfind(b"PK\x05\x06")
    data[at + 10] += 1
    with pytest.raises(ValueError, match="mismatched"):
        epub.check_directory(bytes(data))
    missing = PACKAGE.replace('idref="a"', 'idref="gone"')
    with pytest.raises(Exception, match="unknown manifest item"):
        parse_source(spark, make_epub(tmp_path / "y.epub", package=missing)).chapters.collect()


def test_sizes_and_paths(tmp_path):
    (tmp_path / "t").write_text("abc")
    assert read_text_safely(tmp_path / "t") == "abc"
    with pytest.raises(ValueError):
        read_text_safely(tmp_path / "t", 2)
    for bad in ("../x", "/x", "", "c:/x"):
        with pytest.raises(ValueError):
            safe_upload_path(bad)
    assert dimensions_of(b"GIF89a\x10\x00\x20\x00") == (16, 32)
    assert dimensions_of(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20") == (32, 16)
    assert dimensions_of(b"zz") is None


UNSAFE = ["http://localhost/", "http://a.localhost/", "http://127.0.0.1/", "http://[::1]/", "http://10.0.0.1/", "http://192.168.1.1/", "http://169.254.1.1/", "http://0.0.0.0/", "http://224.0.0.1/", "http://2130706433/", "http://0x7f000001/", "http://127.1/", "http://exa%6dple.com/", "http://example.com:8080/", "http://user:pw@example.com/", "ftp://example.com/"]


@pytest.mark.parametrize("url", UNSAFE)
def test_unsafe_links(url):
    def never(*_a, **_k):
        raise AssertionError("no lookup may happen")

    assert safe_target(url, never) is None


def test_links(spark):
    t = from_sentences(spark, [("a", "A", ["See https://b.org/x and https://a.org/y", "Again https://b.org/x", "More https://c.org/z"])])
    assert [r.url for r in candidates(t, 2).orderBy("n").collect()] == ["https://b.org/x", "https://a.org/y"]
    answers = {"u": (301, "/v"), "http://h/v": (200, None)}
    assert outcome("http://h/u", 1, lambda url, _: (301, "/v") if url.endswith("u") else (200, None)) == "success"
    assert outcome("http://h/u", 1, lambda url, _: (404, None)) == "HTTP status 404"
    assert outcome("http://h/u", 1, lambda url, _: (302, "/u")) == "could not be safely completed" and answers


def test_reports_and_comparison(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<html lang=en><head><title>A</title></head><body><h1>H</h1><p>The same long sentence stands here twice. Doi:10.1234/abc and https://example.invalid too.</p><p>The same long sentence stands here twice.</p></body></html>")
    runs = []
    for name in ("one", "two"):
        assert main(["analyze", str(page), "-o", str(tmp_path / name)], spark) == 0
        runs.append({f.name: f.read_bytes() for f in (tmp_path / name).iterdir()})
    assert runs[0] == runs[1] and set(runs[0]) == {"report.json", "report.html", "findings.csv", "extracted_text.txt", "metadata.json"}
    report = json.loads(runs[0]["report.json"])
    assert set(report) == {"book", "summary", "category_scores", "findings"}
    assert set(report["findings"][0]) == {"id", "severity", "category", "code", "file", "chapter", "paragraph", "sentence", "location", "excerpt", "reason", "review_action", "weight"}
    assert {"exact_sentence", "doi_present", "url_present"} <= {f["code"] for f in report["findings"]}
    assert runs[0]["findings.csv"].startswith(b"id,severity,category,code,file,chapter,paragraph,sentence,excerpt,reason,review_action,weight\r\n")
    assert main(["compare", str(page), str(page), "-o", str(tmp_path / "cmp"), "--fail-on", "critical"], spark) in (0, 1)
    assert json.loads((tmp_path / "cmp" / "report.json").read_text())["score_delta"] == 0
    with pytest.raises(SystemExit):
        main(["analyze", str(tmp_path / "none.txt"), "-o", str(tmp_path / "x")], spark)


def test_stream(spark, tmp_path):
    from quillscan.streaming.ingest import analyze_stream

    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text("As an AI I write.")
    analyze_stream(spark, f"file://{tmp_path}/in", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).count() == 2
