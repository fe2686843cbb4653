import pytest
from pyspark.sql import functions as F

from quillscan.plans import post, scoring
from quillscan.plans.analyze import analyze
from quillscan.plans.rules import CATEGORIES, load_rules
from quillscan.tables import BOOKS, FINDINGS, from_sentences


def finding(**k):
    base = dict(book_id="b", severity="medium", category="repetition", code="c", file="f", chapter="h", paragraph=0, sentence=0, excerpt="e", reason="r", review_action="a", weight=1.0)
    return tuple((base | k).values())


def test_duplicates_and_caps(spark):
    found = post.deduplicated(spark.createDataFrame([finding(weight=100.0), finding(weight=1.0)], FINDINGS))
    assert [r.weight for r in found.collect()] == [100.0]
    books = spark.createDataFrame([("b", "p", "")], BOOKS)
    scores = scoring.category_scores(found, books, load_rules())
    assert {r.category: r.score for r in scores.collect()} == {c: 100.0 if c == "repetition" else 0.0 for c in CATEGORIES}
    heavy = {"weights": {"category": dict.fromkeys(CATEGORIES, 10_000)}, "scoring": {"maximum_score": 10_000}}
    assert scores.groupBy("book_id").agg(scoring.total_score(heavy).alias("t")).first().t == 100.0


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 29.999, 30.0, 59.999, 60.0, 79.999, 80.0, 100.0)], "s double").select(scoring.risk_level(F.col("s"))).collect()
    assert [r[0] for r in rows] == [n for n in ("낮은 위험", "추가 자료 확인 필요", "사람 검토 필요", "우선 검토 필요") for _ in range(2)]


def test_rules(tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text("chatbot_residue:\n  phrases: [x]\nscoring:\n  maximum_score: 50\n")
    rules = load_rules(path)
    assert rules["chatbot_residue"] == {"enabled": True, "phrases": ["x"]} and rules["scoring"]["maximum_score"] == 50
    for bad, part in (({"weights": {"category": {"metdata": 1}}}, "weights.category.metdata"), ({"links": {"enabled": "false"}}, "boolean"), ({"thresholds": {"category_score_points": 0}}, "> 0"), ({"thresholds": {"category_score_points": "many"}}, "number")):
        with pytest.raises(ValueError, match=part):
            load_rules(bad)


def test_ids_and_exclusions(spark):
    import hashlib

    found = post.identified(spark.createDataFrame([finding()], FINDINGS)).first()
    assert found.id == hashlib.sha256("\x1f".join(["repetition", "c", "f", "h", "0", "0", "e", "r"]).encode()).hexdigest()[:16]
    rows = spark.createDataFrame([finding(file="a.xhtml"), finding(file="b.css"), finding(chapter="Notes")], FINDINGS)
    kept = rows.where(~post.excluded({"exclusions": {"file_globs": ["*.css"], "headings": ["Notes"]}})).collect()
    assert [r.file for r in kept] == ["a.xhtml"]


def test_korean_wording(spark):
    t = from_sentences(spark, [("a", "A", ["As an AI I help.", "73% of readers agree", "한국어"])])
    done = analyze(t, load_rules(), "auto")
    rows = {r.code: r for r in done.findings.collect()}
    assert rows["as an ai"].reason == "1인칭 시스템 고지 문구; 독자용 본문에 포함할 표현인지 검토하세요."
    assert rows["uncited_statistic_candidate"].reason == "인용 및 출처 검토 신호입니다. 탐지 규칙: uncited_statistic_candidate; 원문 일부: 73% of readers agree. 원문의 수치, 값 및 출처 문맥을 확인하세요."
    assert done.summary.first().language == "ko"
