"""Text operations as Column expressions; Python is only needed to normalise texts that may not be normal already."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscan.functions.regex import SPACE, java
from quillscan.functions.udf import vectorized

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of normal characters that are passed over first: the longest, and those of characters that texts are made of.
_RUNS, _COMMON = 8, "aéšяλかア漢한’"
# Where lower case and caseless form are one, but for sharp s: ASCII and most of Latin, punctuation and symbols, Han, kana, Hangul.
# Latin by itself is tried first, as two ranges are matched ten times as fast as five.
_LATIN = r"\x{0}-\x{b4}\x{b6}-\x{12f}"
_LOWERED = r"\x{0}-\x{b4}\x{b6}-\x{12f}\x{2010}-\x{2bff}\x{2e80}-\x{a63f}\x{ac00}-\x{d7a3}"
# White space and what becomes it, but for single spaces, which are most of it and stay.
_BLANK = rf"\p{{C}}{SPACE}"
_BLANKS = f"[{_BLANK}&&[^ ]][{_BLANK}]*| [{_BLANK}]+"
WORDS = java(r"[\w'-]+", ignore_case=False)
# Where sentences end.
_SENTENCE_END = java(r"""(?<=[.!?。！？])[\]\)\}"”’']*\s+""", ignore_case=False)
_KOREAN_END = java(r"""(?<=[다요죠까니다십시오])[\]\)\}"”’']*\s+(?=[A-Z가-힣])""", ignore_case=False)


@vectorized("string")
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@cache
def unsure() -> str:
    """An expression for the JVM that finds characters that compatibility normalisation may change.

    Those that it changes alone, marks that it may put in another order, and all that may join with the character before.
    A text without any of them is normal. The class has some hundred ranges, so the longest runs of characters that are not in it
    are passed over first.
    """
    joining = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joining.add(int(parts[1], 16))
    hits = [
        code for code in range(0x80, sys.maxunicode + 1)
        if not 0xD800 <= code < 0xE000 and (code in joining or unicodedata.combining(chr(code)) or not unicodedata.is_normalized("NFKC", chr(code)))
    ]
    ranges, between = [[hits[0], hits[0]]], [(0, hits[0] - 1)]
    for code in hits[1:]:
        if code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            between.append((ranges[-1][1] + 1, code - 1))
            ranges.append([code, code])
    written = lambda pairs: "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in pairs)
    common = sorted({*sorted(between, key=lambda r: r[0] - r[1])[:_RUNS], *[r for r in between if any(r[0] <= ord(c) <= r[1] for c in _COMMON)]})
    return f"(?=[^{written(common)}])[{written(ranges)}]"


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """Caseless forms beyond ASCII: characters and what each becomes, and those that become several."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        form = chr(code).casefold()
        if form != chr(code):
            (single if len(form) == 1 else several)[chr(code)] = form
    return "".join(single), "".join(single.values()), several


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """Compatibility normalisation, control and unassigned characters as spaces, white space collapsed.

    Python sees only texts with a character that may not be normal; ``nfkc=False`` leaves it out for corpora known to be normal.
    """
    if nfkc:
        text = F.coalesce(_nfkc(F.when(text.rlike(unsure()), text)), text)
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def split_sentences(normal: Column) -> Column:
    """Sentences of normalised text, in order: after terminal punctuation, and after Korean endings before a new start."""
    parts = F.split(normal, _SENTENCE_END)
    parts = F.when(normal.rlike("[가-힣]"), F.flatten(F.transform(parts, lambda p: F.split(p, _KOREAN_END)))).otherwise(parts)
    # a lambda of one argument: F.trim itself would be given the place in the list as the characters to trim
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def split_paragraphs(text: Column, nfkc: bool = True) -> Column:
    """Normalised paragraphs of raw text, at blank lines; empty ones dropped."""
    parts = F.split(text, r"(?:\r?\n){2,}")
    if nfkc:
        normal = _nfkc(F.when((F.octet_length(text) > F.length(text)) & text.rlike(unsure()), F.array_join(parts, "\u0000")))
        parts = F.coalesce(F.split(normal, "\u0000"), parts)
    return F.filter(F.transform(parts, lambda p: normalize_text(p, nfkc=False)), lambda p: p != "")


def casefold(text: Column) -> Column:
    """Caseless form, for all of Unicode: lower case where the text has no other characters than those for which that is the same."""
    plain, forms, several = folds()
    other = F.translate(text, _UPPER + plain, _UPPER.lower() + forms)
    # one constant in the plan, instead of a hundred nested calls in the compiled code
    pairs = F.array(*[F.struct(F.lit(char).alias("char"), F.lit(form).alias("form")) for char, form in several.items()])
    many = F.aggregate(pairs, other, lambda done, p: F.replace(done, p["char"], p["form"]))
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.when(~text.rlike(f"[^{_LATIN}]"), lowered).when(~text.rlike(f"[^{_LOWERED}]"), lowered).when(text.rlike("[" + "".join(several) + "]"), many).otherwise(other)


def words(text: Column) -> Column:
    """Tokens: runs of letters, digits, underscore, apostrophe and hyphen."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def may_hold(text: Column, needles: Iterable[str]) -> Column:
    """Whether a text may match, case ignored as by ``(?iu)``, a pattern that needs one of these lower-case ASCII literals.

    Much cheaper than a pattern. Lower case is that of patterns but for long s, dotless i and dotted I, so texts with these may always match.
    """
    asked = [*dict.fromkeys(needles), "ſ", "ı", "\u0307"]
    return F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, [low.contains(n) for n in asked]))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def word_count(text: Column) -> Column:
    """White-space separated words of normalised text."""
    return F.size(F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0)))


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, 300)


def percent(ratio: Column, digits: int = 0) -> Column:
    """Percentage with halves rounded to even, as text."""
    kind = f"decimal(38,{digits})"
    return F.concat(F.bround(ratio * 100, digits).cast(kind).cast("string"), F.lit("%"))
