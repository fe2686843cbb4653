"""Command line: analyse a book, or compare two."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from quillscan.plans import report
from quillscan.plans.analyze import Analysis, analyze, fails
from quillscan.plans.rules import load_rules
from quillscan.sources.files import parse_source


def _size(text: str) -> int:
    if not text.isdigit() or int(text) <= 0:
        raise argparse.ArgumentTypeError("max-file-size must be a positive number of bytes")
    return int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillscan", description="Review signals for human readers of EPUB, HTML and text books.")
    commands = out.add_subparsers(dest="command", required=True)
    for name, sources in (("analyze", ["SOURCE"]), ("compare", ["SOURCE1", "SOURCE2"])):
        c = commands.add_parser(name)
        for source in sources:
            c.add_argument(source, type=Path)
        c.add_argument("--verbose", action="store_true")
        c.add_argument("--output", "-o", required=True, type=Path)
        c.add_argument("--language", choices=("auto", "ko", "en"), default="auto")
        c.add_argument("--verify-links", action="store_true")
        c.add_argument("--max-file-size", type=_size)
        c.add_argument("--config", type=Path)
        c.add_argument("--format", choices=report.FORMATS, default="all")
        c.add_argument("--fail-on", choices=("high", "critical", "never"), default="never")
    return out


def session() -> SparkSession:
    return SparkSession.builder.appName("quillscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def analyze_source(spark: SparkSession, source: str | Path, config: Any = None, language: str = "auto", verify_links: bool = False, max_file_size: int | None = None) -> Analysis:
    return analyze(parse_source(spark, source, max_file_size).persisted(), load_rules(config), language, verify_links)


def compare_sources(spark: SparkSession, source1: str | Path, source2: str | Path, config: Any = None, language: str = "auto", verify_links: bool = False, max_file_size: int | None = None) -> tuple[dict[str, Any], list[Analysis]]:
    """Both books' summaries and the differences of their scores, second less first."""
    both = [analyze_source(spark, s, config, language, verify_links, max_file_size) for s in (source1, source2)]
    records = [report.book_records(a).first()["record"].asDict(recursive=True) for a in both]
    left, right = records
    books = [{"source": r["book"]["source_file"], "sha256": r["book"]["sha256"], "summary": {k: v for k, v in r["summary"].items() if k not in ("risk_score", "chapter_count", "word_count")}, "category_scores": r["category_scores"]} for r in records]
    deltas = {k: right["category_scores"][k] - v for k, v in sorted(left["category_scores"].items())}
    return {"books": books, "score_delta": right["summary"]["overall_score"] - left["summary"]["overall_score"], "category_score_delta": deltas}, both


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING, format="%(levelname)s: %(message)s")
    spark = spark or session()
    options = (args.config, args.language, args.verify_links, args.max_file_size)
    try:
        if args.command == "analyze":
            done = [analyze_source(spark, args.SOURCE, *options)]
            report.write_reports(done[0], args.output, args.format)
        else:
            comparison, done = compare_sources(spark, args.SOURCE1, args.SOURCE2, *options)
            report.write_comparison(comparison, args.output, args.format)
        return int(any(r["fails"] for a in done for r in fails(a.summary, args.fail_on).collect()))
    except (OSError, ValueError) as error:
        parser().error(str(error))
    return 2


if __name__ == "__main__":
    sys.exit(main())
