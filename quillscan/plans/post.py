"""What happens to findings after detection: exclusion, localisation, removal of duplicates, ids."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.tables import Tables

# Korean wording.
CHATBOT_KO = {
    "First-person system disclaimer": "1인칭 시스템 고지 문구",
    "Conversational refusal": "대화형 거절 표현",
    "Instruction-like wording": "지시문과 유사한 표현",
    "Conversation role label": "대화 역할 표지",
    "Conversational assistant phrasing": "대화형 보조자 표현",
    "Instruction-like Chinese wording": "지시문과 유사한 중국어 표현",
    "Instruction-like Korean wording": "지시문과 유사한 한국어 표현",
    "Unresolved template marker": "미해결 템플릿 표지",
    "Configured conversational phrase": "설정된 대화형 표현",
    "; review whether it belongs in reader-facing prose.": "; 독자용 본문에 포함할 표현인지 검토하세요.",
}
CHATBOT_FALLBACK_KO = "대화형 문구 검토 신호입니다. 독자용 본문에 포함할 표현인지 검토하세요."
ACTIONS_KO = {
    "Confirm this wording is intentional or revise/remove it.": "이 표현이 의도된 것인지 확인하고, 필요하면 수정하거나 제거하세요.",
    "Review the surrounding claim and add, correct, or document an appropriate source where needed.": "주변 주장을 검토하고, 필요하면 적절한 출처를 추가, 수정 또는 기록하세요.",
    "Compare the referenced passages and confirm the intended value or wording.": "참조된 구절을 검토·비교하여 의도한 값이나 표현을 확인하세요.",
    "Review this image resource and its EPUB manifest or HTML references.": "이 이미지 리소스와 EPUB 매니페스트 또는 HTML 참조를 검토하세요.",
    "Confirm the resource inventory and intended image coverage.": "리소스 목록과 의도한 이미지 범위를 확인하세요.",
    "Review the EPUB package metadata and align it with the publication’s displayed information.": "EPUB 패키지 메타데이터를 검토하고 출판물 표시 정보와 맞추세요.",
    "Compare the occurrences and retain, vary, or remove intentional repetition.": "반복 위치를 검토·비교하여 의도된 반복을 유지, 변경 또는 제거하세요.",
    "Check the book structure and revise the source or navigation metadata as needed.": "도서 구조를 확인하고 필요하면 원본 또는 탐색 메타데이터를 수정하세요.",
    "Review this pattern in context and revise only where it affects readability or voice.": "문맥에서 이 패턴을 검토하고 가독성이나 문체에 영향을 주는 경우에만 수정하세요.",
    "Confirm the link manually or update/remove it from the publication.": "링크를 직접 확인하고 출판물에서 업데이트하거나 제거하세요.",
}
ACTION_FALLBACK_KO = "원문의 위치와 문맥을 사람이 검토하여 필요한 경우에만 수정하세요."
CATEGORY_KO = {
    "chatbot_residue": "대화형 문구 검토 신호",
    "repetition": "반복 표현 검토 신호",
    "style_patterns": "문체 패턴 검토 신호",
    "structure": "도서 구조 검토 신호",
    "citations": "인용 및 출처 검토 신호",
    "consistency": "표현 일관성 검토 신호",
    "images": "이미지 리소스 검토 신호",
    "metadata": "출판 메타데이터 검토 신호",
}
KEY = ["book_id", "category", "code", "file", "chapter", "paragraph", "sentence", "excerpt", "reason"]


def excluded(rules: Mapping[str, Any]) -> Column:
    """Whether the rules' exclusions suppress a finding."""
    part = rules.get("exclusions", {})
    lists = {k: [x for x in part.get(k, []) if isinstance(x, str)] if isinstance(part, Mapping) and isinstance(part.get(k, []), list) else [] for k in ("files", "file_globs", "phrases", "headings")}
    out = F.col("file").isin(lists["files"]) | F.col("excerpt").isin(lists["phrases"]) | F.col("chapter").isin(lists["headings"])
    for glob in lists["file_globs"]:
        out = out | F.col("file").rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?s)^(?:"))
    return F.coalesce(out, F.lit(False))


def resolve_language(tables: Tables, language: str = "auto") -> DataFrame:
    """(book_id, language): given, declared, or Korean if the first 10,000 characters hold a Hangul syllable.

    A book's sentences are put in order by their lengths and the place of their first Hangul syllable; no text moves.
    """
    if language not in {"auto", "ko", "en"}:
        raise ValueError("language must be one of: auto, ko, en")
    books = tables.books.select("book_id")
    if language != "auto":
        return books.withColumn("language", F.lit(language))
    declared = tables.metadata.where("key = 'language'").groupBy("book_id").agg(F.min(F.struct("pos", "value"))["value"].alias("declared"))
    code = F.regexp_replace(F.lower("declared"), "_", "-")
    reading = Window.partitionBy("book_id").orderBy("ord")
    first = F.when(F.col("text").rlike("[가-힣]"), F.length(F.regexp_extract("text", "^[^가-힣]*", 0)))
    sizes = tables.sentences.select("book_id", "ord", (F.length("text") + 1).alias("size"), first.alias("first"))
    before = F.sum("size").over(reading.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    korean = sizes.withColumn("before", before).where("before + first < 10000").select("book_id").distinct().withColumn("hangul", F.lit(True))
    rows = books.join(declared, "book_id", "left").join(korean, "book_id", "left")
    return rows.select("book_id", F.when(code.startswith("ko"), "ko").when(code.startswith("en"), "en").when(F.col("hangul"), "ko").otherwise("en").alias("language"))


def _link_reason() -> Column:
    url = F.regexp_extract("reason", r"(?i)https?://[^\s<>\])}]+", 0)
    status = F.regexp_extract("reason", r"(?<![\p{L}\p{N}_])(?:HTTP status )?(\p{Nd}{3})(?![\p{L}\p{N}_])", 1)
    detail = F.when(status != "", F.concat(F.lit("HTTP 상태 "), status)).when(F.contains(F.col("reason"), F.lit("request could not be completed")), "요청을 완료할 수 없음").otherwise("확인 결과를 가져올 수 없음")
    return F.concat(F.lit("링크 확인이 요청되었고 "), url, F.lit("에서 문제가 감지되었습니다. 응답 정보: "), detail, F.lit(". URL과 출처 문맥을 검토하세요."))


def localized(findings: DataFrame, languages: DataFrame) -> DataFrame:
    """Findings of Korean books in Korean wording; all others as they are. Books' languages are one row a book."""
    chat = F.col("reason")
    for english, korean in CHATBOT_KO.items():
        chat = F.replace(chat, F.lit(english), F.lit(korean))
    chat = F.when(chat.rlike("[A-Za-z]{3}"), CHATBOT_FALLBACK_KO).otherwise(chat)
    label = F.lit("검토 신호")
    for category, text in CATEGORY_KO.items():
        label = F.when(F.col("category") == category, text).otherwise(label)
    inner = F.regexp_extract("reason", r"\(([^()]*)\)", 1)
    numbers = F.regexp_extract_all("reason", F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?"), F.lit(0))
    details = F.array(
        F.concat(F.lit("탐지 규칙: "), F.col("code")),
        F.when(F.col("reason").rlike(r"\([^()]*\)"), F.concat(F.lit("감지된 값: "), inner)),
        F.when(F.col("code") == "source_needed_marker", "감지된 출처 표지: source-needed marker"),
        F.when(F.size(numbers) > 0, F.concat(F.lit("근거 수치: "), F.array_join(numbers, ", "))),
        F.when(F.col("excerpt") != "", F.concat(F.lit("원문 일부: "), F.substring("excerpt", 1, 160))),
    )
    other = F.concat(label, F.lit("입니다. "), F.array_join(details, "; "), F.lit(". 원문의 수치, 값 및 출처 문맥을 확인하세요."))
    reason = F.when(F.col("code") == "link_verification", _link_reason()).when(F.col("category") == "chatbot_residue", chat).otherwise(other)
    action = F.lit(ACTION_FALLBACK_KO)
    for english, korean in ACTIONS_KO.items():
        action = F.when(F.col("review_action") == english, korean).otherwise(action)
    korean = F.col("language") == "ko"
    rows = findings.join(languages, "book_id", "left")
    return rows.withColumns({"reason": F.when(korean, reason).otherwise(F.col("reason")), "review_action": F.when(korean, action).otherwise(F.col("review_action"))}).drop("language")


def deduplicated(findings: DataFrame) -> DataFrame:
    """Of findings that agree in place, excerpt and reason the heaviest; partial aggregates meet, no window is sorted."""
    best = F.max(F.struct("weight", "severity", "review_action")).alias("b")
    return findings.groupBy(*KEY).agg(best).select("*", "b.*").drop("b")


def identified(findings: DataFrame) -> DataFrame:
    """With the id: the first 16 hexadecimal digits of SHA-256 over place, excerpt and reason."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY[1:]]
    return findings.withColumn("id", F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16))


ORDER = ["book_id", "category", "file", "chapter", "paragraph", "sentence", "code", "id"]
