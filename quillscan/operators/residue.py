"""Conversational residue: the first matching pattern of every sentence."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.phrases import phrases_in
from quillscan.functions.regex import java, quoted
from quillscan.functions.text import may_hold
from quillscan.operators._findings import findings, setting
from quillscan.plans.rules import checked_entries
from quillscan.tables import FINDINGS, Tables

# Codes, patterns and reasons, in the order in which they are tried.
PATTERNS = (
    ("as an ai", r"\b(?:as|being) an ai(?: language model)?\b", "First-person system disclaimer"),
    ("cannot comply", r"\b(?:i (?:cannot|can't)|unable to) (?:comply|help|provide)\b", "Conversational refusal"),
    ("prompt instruction", r"\b(?:ignore|follow) (?:the )?(?:previous|above|these) instructions\b", "Instruction-like wording"),
    ("assistant label", r"(?:^|\n)\s*(?:assistant|user|system)\s*:", "Conversation role label"),
    ("chinese assistant", r"(?:作为(?:一个)?(?:人工智能|ai)|我无法(?:帮助|提供)|请(?:告诉|提供)我)", "Conversational assistant phrasing"),
    ("chinese prompt", r"(?:忽略(?:之前|以上).*指令|以下是.*(?:回答|回复)|作为语言模型)", "Instruction-like Chinese wording"),
    ("korean assistant", r"(?:(?:인공지능|ai)\s*(?:언어\s*)?모델로서|(?:요청|그\s*요청).{0,30}?(?:도울|수행할|제공할)\s*수\s*없(?:습니다|어요))", "Conversational assistant phrasing"),
    ("korean prompt", r"(?:이전|앞선|위(?:의)?|기존)\s*(?:지시(?:사항)?|명령|지침).{0,30}?(?:무시|따르지)", "Instruction-like Korean wording"),
    ("template marker", r"\{\{[^{}]{2,80}\}\}|\[[A-Z][A-Z_ ]{2,}\]", "Unresolved template marker"),
)
ACTION = "Confirm this wording is intentional or revise/remove it."
TAIL = "; review whether it belongs in reader-facing prose."


# What each of these patterns cannot do without, in lower case.
NEEDLES = {
    "as an ai": (" an ai",), "cannot comply": ("cannot", "can't", "unable to"), "prompt instruction": (" instructions",), "assistant label": ("assistant", "user", "system"),
    "chinese assistant": ("作为", "我无法", "请"), "chinese prompt": ("忽略", "以下是", "作为语言模型"), "korean assistant": ("모델로서", "요청"), "korean prompt": ("지시", "명령", "지침"), "template marker": ("{{", "["),
}


def _needles(patterns, phrases) -> list[str] | None:
    """What a sentence must hold one of for any entry to match; None where that is not known of all of them."""
    shipped = {p: NEEDLES[code] for code, p, _ in PATTERNS}
    if any(p not in shipped for _, p, _ in patterns) or not all(c.isascii() or unicodedata.category(c) == "Lo" and c.upper() == c for p in phrases for c in p):
        return None
    return [n for _, p, _ in patterns for n in shipped[p]] + [p.lower() for p in phrases]


#: So many phrases are tried one by one; longer lists go through an automaton.
FEW = 16


def _entries(rules) -> tuple:
    return checked_entries(setting(rules, "chatbot_residue", "patterns", PATTERNS), setting(rules, "chatbot_residue", "phrases", ()))


def may_match(rules=None) -> Column:
    """Whether a sentence may match an entry of the rules; cheap, and true where that is not known."""
    patterns, phrases = _entries(rules)
    needles = _needles(patterns, phrases) if len(phrases) <= FEW else None
    return F.lit(True) if needles is None else may_hold(F.col("text"), needles)


def detect(tables: Tables, rules=None) -> DataFrame:
    """The first entry of the rules that each sentence matches: patterns in their order, then phrases."""
    spark = tables.sentences.sparkSession
    if not setting(rules, "chatbot_residue", "enabled", True):
        return spark.createDataFrame([], FINDINGS)
    patterns, phrases = _entries(rules)
    said = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason + TAIL).alias("reason"))
    tried = [F.when(F.col("text").rlike(java(p)), said(code, reason)) for code, p, reason in patterns]
    configured = said("configured_phrase", "Configured conversational phrase")
    if len(phrases) > FEW:
        tried.append(F.when(F.size(phrases_in(spark, F.col("text"), phrases)) > 0, configured))
    else:
        tried += [F.when(F.col("text").rlike(quoted(p)), configured) for p in phrases]
    if not tried:
        return spark.createDataFrame([], FINDINGS)
    rows = tables.sentences.where(may_match(rules)).withColumn("hit", F.coalesce(*tried)).where("hit is not null")
    return findings(rows, "chatbot_residue", F.col("hit.code"), "medium", F.col("hit.reason"), ACTION, 1.0)
