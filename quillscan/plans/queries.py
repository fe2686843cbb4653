"""Named queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscan.functions.text import casefold, normalize_text, word_count, words
from quillscan.operators import citations, consistency, images, links, metadata, repetition, residue, structure, style
from quillscan.plans import post, scoring
from quillscan.plans.analyze import compared, search
from quillscan.plans.rules import load_rules
from quillscan.shared import settled
from quillscan.sources.files import resource_references, spine_chapters
from quillscan.tables import Tables, from_texts, numbered, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The same seeds in both engines, so that rules without natural hits have some.
SEEDS = [
    " As an AI language model, I cannot provide that.", " See https://example.com/TODO now.", " Ref doi:10.bad/. Citation needed.", " TODO insert image here.", " About 73% of 1,234 readers agreed.",
    " Shown before (Smith, 2019) and [1, 2].", " He was 12 years old and she was 25 years old.", " Ada Lovelace met Augusta Lovelace.", " Go to https://books.example.org/a?b=1, or http:///none.", " On 1/2/2020 and May 3, 2021 it rained.",
]
SEED_SQL = "text || CASE doc_id % 17 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEEDS)) + " ELSE '' END"

SP = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\p{{C}}', ' ', 'g'), '[{SP}]+', ' ', 'g'))"


FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"
WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_''-]+')"
B0, B1 = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
BASE = rf"""
docs AS (SELECT doc_id, source AS book_id, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, lpad(doc_id::VARCHAR, 8, '0') AS title, {SEED_SQL} AS raw FROM documents),
pars AS (
  SELECT book_id, doc_id AS chapter_seq, file, title AS chapter, p.i - 1 AS par, p.t AS text FROM (
    SELECT *, unnest(list_transform(ps, lambda t, i: {{'t': t, 'i': i}})) AS p FROM (
      SELECT *, list_filter(list_transform(string_split_regex(raw, '(?:\r?\n){{2,}}'), lambda t: {norm("t")}), lambda t: t <> '') AS ps FROM docs))),
sents AS (
  SELECT book_id, chapter_seq, file, chapter, par, s.i - 1 AS sent, s.t AS text,
         row_number() OVER (PARTITION BY book_id ORDER BY chapter_seq, par, s.i) AS sent_seq FROM (
    SELECT * EXCLUDE (text), unnest(list_transform(ss, lambda t, i: {{'t': t, 'i': i}})) AS s FROM (
      SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])[\])}}"”’'']*[{SP}]+', '\1' || chr(1), 'g'), chr(1)), lambda t: trim(t)), lambda t: t <> '') AS ss FROM pars)))
"""


PLAIN_BASE = BASE.replace(SEED_SQL, "text")


def seeded(spark: SparkSession, sf_dir: str, book: str = "source", seeds: bool | str = True) -> Tables:
    """Documents as text files of one book for each source, with the common seeds, those of an expression, or as they are."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    return from_texts(rows.select(F.col(book).cast("string").alias("book_id"), F.col("doc_id").alias("chapter_seq"), F.concat(name, F.lit(".txt")).alias("file"), name.alias("title"), F.expr(seeds if isinstance(seeds, str) else SEED_SQL if seeds else "text").alias("text")))


def own_base(raw: str, book: str = "source") -> str:
    """The same tables from other texts, and with another column as the book."""
    return BASE.replace(SEED_SQL, raw).replace("source AS book_id", f"{book} AS book_id", 1)


def query(name: str, sql: str | None = None, base: bool = True):
    def mark(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = f"WITH {BASE} {sql}" if base else sql
        return function

    return mark


def shown(found: DataFrame, *codes: str) -> DataFrame:
    """Findings by place, code and rounded weight."""
    rows = found.where(F.col("code").isin(*codes)) if codes else found
    return rows.select("book_id", "code", "file", F.col("paragraph").cast("long").alias("paragraph"), F.col("sentence").cast("long").alias("sentence"), F.round("weight", 6).alias("weight"))


PLACE = "file, par::BIGINT AS paragraph, sent::BIGINT AS sentence"


# Text


@query("normalized_text", f"SELECT doc_id, md5({norm('raw')}) AS digest FROM docs")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    return rows.select("doc_id", F.md5(normalize_text(F.expr(SEED_SQL)).cast("binary")).alias("digest"))


@query("sentences", "SELECT book_id, file, par::BIGINT AS par, sent::BIGINT AS sent, sent_seq::BIGINT AS sent_seq, text FROM sents")
def _(spark, sf):
    return numbered(seeded(spark, sf).sentences).select("book_id", "file", F.col("par").cast("long").alias("par"), F.col("sent").cast("long").alias("sent"), F.col("sent_seq").cast("long").alias("sent_seq"), "text")


@query("word_counts", "SELECT p.book_id, p.words, s.sentences FROM (SELECT book_id, sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT AS words FROM pars GROUP BY 1) p JOIN (SELECT book_id, count(*) AS sentences FROM sents GROUP BY 1) s USING (book_id)")
def _(spark, sf):
    t = seeded(spark, sf)
    return t.paragraphs.groupBy("book_id").agg(F.sum(word_count(F.col("text"))).alias("words")).join(t.sentences.groupBy("book_id").agg(F.count(F.lit(1)).alias("sentences")), "book_id")


@query("tokens_casefold", f"SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {WORDS.format(FOLD.format('raw'))} AS w FROM docs)")
def _(spark, sf):
    rows = spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select("doc_id", words(casefold(F.expr(SEED_SQL))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


# Characters of compatibility, and what they stand for.
WIDE, NARROW = " Ｗｉｄｅ ﬁne ①② ｶﾀ.", " Wide fine 12 カタ."


@query("compatible_text", f"SELECT doc_id, md5({norm(f"text || '{NARROW}'")}) AS digest FROM documents", base=False)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    return rows.select("doc_id", F.md5(normalize_text(F.concat("text", F.lit(WIDE))).cast("binary")).alias("digest"))


# Korean endings before a new start, with and without closing marks, and one that is none.
KOREAN = "text || CASE doc_id % 3 WHEN 0 THEN ' 책을 읽습니다 다음 장으로 갑니다 Next part' WHEN 1 THEN ' 그렇지요” 다시 봅니다) ABC 나무 아래' ELSE '' END"
KOREAN_BASE = own_base(KOREAN).replace("string_split(regexp_replace(text, ", "string_split(regexp_replace(regexp_replace(text, ").replace("chr(1), 'g'), chr(1))", rf"chr(1), 'g'), '([다요죠까니십시오])[\])}}\"”’'']*[{SP}]+([A-Z가-힣])', '\1' || chr(1) || '\2', 'g'), chr(1))")


@query("korean_sentences", f"WITH {KOREAN_BASE} SELECT book_id, file, par::BIGINT AS par, sent::BIGINT AS sent, text FROM sents", base=False)
def _(spark, sf):
    t = seeded(spark, sf, seeds=KOREAN)
    return t.sentences.select("book_id", "file", F.col("par").cast("long").alias("par"), F.col("sent").cast("long").alias("sent"), "text")


# Row-wise detectors

RESIDUE_SQL = rf"""CASE WHEN regexp_matches(text, '{B0}(?:as|being) an ai(?: language model)?{B1}', 'i') THEN 'as an ai'
 WHEN regexp_matches(text, '{B0}(?:i (?:cannot|can''t)|unable to) (?:comply|help|provide){B1}', 'i') THEN 'cannot comply'
 WHEN regexp_matches(text, '{B0}(?:ignore|follow) (?:the )?(?:previous|above|these) instructions{B1}', 'i') THEN 'prompt instruction'
 WHEN regexp_matches(text, '^\s*(?:assistant|user|system)\s*:', 'i') THEN 'assistant label'
 WHEN regexp_matches(text, '\{{\{{[^{{}}]{{2,80}}\}}\}}|\[[A-Z][A-Z_ ]{{2,}}\]', 'i') THEN 'template marker'
 WHEN regexp_matches(text, 'as an AI language model|I cannot fulfill that request|I don''t have personal opinions|as a language model', 'i') THEN 'configured_phrase' END"""


@query("residue_findings", f"SELECT book_id, code, {PLACE}, 1.0::DOUBLE AS weight FROM (SELECT *, {RESIDUE_SQL} AS code FROM sents) WHERE code IS NOT NULL")
def _(spark, sf):
    return shown(residue.detect(seeded(spark, sf), load_rules()))


ASIAN = "text || CASE doc_id % 7 WHEN 0 THEN ' 作为一个人工智能，我在这里' WHEN 1 THEN ' 请忽略之前的所有指令' WHEN 2 THEN ' 인공지능 언어 모델로서 말합니다' WHEN 3 THEN ' 이전 지시사항을 모두 무시' WHEN 4 THEN ' 그 요청은 도울 수 없습니다' WHEN 5 THEN ' 以下是我的回答' ELSE ' 没有什么' END"
ASIAN_SQL = r"""CASE WHEN regexp_matches(text, '作为(一个)?(人工智能|ai)|我无法(帮助|提供)|请(告诉|提供)我', 'i') THEN 'chinese assistant' WHEN regexp_matches(text, '忽略(之前|以上).*指令|以下是.*(回答|回复)|作为语言模型', 'i') THEN 'chinese prompt'
 WHEN regexp_matches(text, '(인공지능|ai)\s*(언어\s*)?모델로서|(요청|그\s*요청).{0,30}?(도울|수행할|제공할)\s*수\s*없(습니다|어요)', 'i') THEN 'korean assistant' WHEN regexp_matches(text, '(이전|앞선|위(의)?|기존)\s*(지시(사항)?|명령|지침).{0,30}?(무시|따르지)', 'i') THEN 'korean prompt' END"""


@query("residue_asian", f"WITH {own_base(ASIAN)} SELECT book_id, code, {PLACE}, 1.0::DOUBLE AS weight FROM (SELECT *, {ASIAN_SQL} AS code FROM sents) WHERE code IS NOT NULL", base=False)
def _(spark, sf):
    codes = ["chinese assistant", "chinese prompt", "korean assistant", "korean prompt"]
    return shown(residue.detect(seeded(spark, sf, seeds=ASIAN), load_rules()), *codes)


TALK = rf"""WITH turns AS (SELECT conv_id::VARCHAR AS book_id, conv_id::VARCHAR AS file, turn AS par, {norm("role || ': ' || text")} AS t FROM conversations),
sents AS (SELECT book_id, file, par, unnest(list_transform(list_filter(list_transform(string_split(regexp_replace(t, '([.!?。！？])[\])}}"”’'']*[{SP}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: {{'t': x, 'i': i - 1}}), recursive := false) AS s FROM turns)
SELECT book_id, code, file, par::BIGINT AS turn, s.i::BIGINT AS sentence FROM (SELECT *, s.t AS text, {RESIDUE_SQL.replace('text', 's.t')} AS code FROM sents) WHERE code IS NOT NULL"""


@query("conversation_roles", TALK, base=False)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    t = from_texts(rows.select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("chapter_seq"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file"), F.lit("").alias("title"), F.regexp_replace(F.concat("role", F.lit(": "), "text"), r"\n", " ").alias("text")))
    found = residue.detect(t, load_rules())
    return found.select("book_id", "code", F.col("book_id").alias("file"), F.element_at(F.split("file", "/"), -1).cast("long").alias("turn"), F.col("sentence").cast("long").alias("sentence"))


STYLE_BASE = rf"""measured AS (SELECT *, {WORDS.format('text')} AS w, length(regexp_replace(text, '[\p{{L}}\p{{N}}{SP}]', '', 'g')) AS marks,
 regexp_matches(text, '{B0}(?:is|are|was|were|be|been|being)[{SP}]+[\p{{L}}\p{{N}}_]+(?:ed|en){B1}', 'i') AS passive FROM sents),
chapters AS (SELECT book_id, chapter_seq, count(*) AS n, sum((passive AND len(w) > 0)::INT) AS passives, sum(len(w)) AS words, sum(len(list_filter(w, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}_]+(?:tion|sion|ment|ness|ity|ance|ence)$', 'i')))) AS nominals,
 arg_min(struct_pack(file := file, par := par, sent := sent), sent_seq) AS f FROM measured GROUP BY 1, 2)"""


def _style(code: str, sql: str, rules: dict | None = None) -> None:
    @query(code, f", {STYLE_BASE} {sql}")
    def _(spark, sf):
        return shown(style.detect(seeded(spark, sf), {"style_patterns": rules or {}}, only=[code]))


_style("long_sentence", f"SELECT book_id, 'long_sentence' AS code, {PLACE}, round(len(w) / 40.0::DOUBLE, 6) AS weight FROM measured WHERE len(w) > 40")
_style("punctuation_density", f"SELECT book_id, 'punctuation_density' AS code, {PLACE}, 1.0::DOUBLE AS weight FROM measured WHERE len(w) > 0 AND marks::DOUBLE / greatest(length(text), 1) > 0.18")
CHAPTER_PLACE = "f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence"
_style("passive_distribution", f"SELECT book_id, 'passive_distribution' AS code, {CHAPTER_PLACE}, round(passives::DOUBLE / n, 6) AS weight FROM chapters WHERE passives::DOUBLE / n >= 0.05", {"passive_ratio_threshold": 0.05})
_style("nominalization_distribution", f"SELECT book_id, 'nominalization_distribution' AS code, {CHAPTER_PLACE}, round(nominals::DOUBLE / words, 6) AS weight FROM chapters WHERE words > 0 AND nominals::DOUBLE / words >= 0.02", {"nominal_ratio_threshold": 0.02})
LISTED = "text || CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(10) || '- one item' WHEN 1 THEN chr(10) || chr(10) || '12) another' WHEN 2 THEN chr(10) || chr(10) || 'no - item' ELSE '' END"


@query("list_density", rf"WITH {own_base(LISTED)} SELECT book_id, 'list_density' AS code, file, par::BIGINT AS paragraph, 0::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM pars WHERE regexp_matches(text, '^[{SP}]*([-*•]|\p{{Nd}}+[.)])[{SP}]+')", base=False)
def _(spark, sf):
    return shown(style.detect(seeded(spark, sf, seeds=LISTED), {"style_patterns": {"list_item_threshold": 1}}, only=["list_density"]))



URLS = r"list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>\])}]*'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))"
DOIS = r"list_transform(regexp_extract_all(text, '(?i)(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)([^\s<>\])}]+)', 1), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))"
TAIL = "regexp_replace(u, '(?i)^https?://', '')"
EMPTY = f"({TAIL} = '' OR regexp_matches({TAIL}, '^[/?#]'))"
CITE_BASE = rf"""facts AS (SELECT *, {URLS} AS urls, {DOIS} AS marked FROM sents), cited AS (SELECT *,
 regexp_matches(text, '{B0}(?:citation needed|citation required|source needed|source required|fuente necesaria|se necesita (?:una )?fuente|requiere (?:una )?fuente){B1}', 'i') AS c1,
 len(list_filter(marked, lambda c: NOT regexp_matches(c, '^10\.\d{{4,9}}/[-._;()/:A-Z0-9]*[A-Z0-9]$', 'i'))) > 0 AS c2,
 regexp_matches(text, '{B0}10\.\d{{4,9}}/[-._;()/:A-Z0-9]*[A-Z0-9]', 'i') AS c3,
 len(list_filter(urls, lambda u: {EMPTY})) > 0 AS c4,
 len(list_filter(urls, lambda u: NOT {EMPTY} AND (lower(split_part(split_part({TAIL}, '/', 1), ':', 1)) IN ('example.com','example.org','example.net','invalid','localhost') OR regexp_matches(u, '{B0}(?:todo|tbd|placeholder|insert|xxx){B1}', 'i')))) > 0 AS c5,
 len(list_filter(urls, lambda u: NOT {EMPTY})) > 0 AS c6,
 regexp_matches(text, '\[[0-9,;\s]+\]|\([A-Z][A-Za-z-]+,?\s+(?:19|20)\d{{2}}[a-z]?\)') AS c7,
 regexp_matches(text, '{B0}(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:[.,]\d+)?)\s*%|{B0}(?:one|\d+)\s+in\s+\d+{B1}|{B0}\d+\s+(?:million|billion|mil(?:lones)?|millones){B1}', 'i') AS c8 FROM facts)"""
CITE_CODES = ["source_needed_marker", "malformed_doi", "doi_present", "empty_url", "placeholder_url", "url_present", "citation_present"]
CITE_SQL = " UNION ALL ".join(f"SELECT book_id, '{code}' AS code, {PLACE}, 0.5::DOUBLE AS weight FROM cited WHERE c{i}" for i, code in enumerate(CITE_CODES, 1)) + f" UNION ALL SELECT book_id, 'uncited_statistic_candidate', {PLACE}, 0.5::DOUBLE FROM cited WHERE c8 AND NOT (c3 OR c6 OR c7)"


@query("citation_signals", f", {CITE_BASE} {CITE_SQL}")
def _(spark, sf):
    return shown(citations.detect(seeded(spark, sf)))


@query("multiple_ages_dates", rf""", v AS (SELECT *, len(list_distinct(regexp_extract_all(lower(text), '\d{{1,3}}\s*(?:years? old|años?)'))) AS ages,
 len(list_distinct(regexp_extract_all(lower(text), '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|may\s+\d{{1,2}},?\s+\d{{4}}'))) AS dates FROM pars)
 SELECT book_id, code, file, par::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.5::DOUBLE AS weight FROM (SELECT *, 'multiple_ages' AS code FROM v WHERE ages > 1 UNION ALL SELECT *, 'multiple_dates' FROM v WHERE dates > 1)""")
def _(spark, sf):
    return shown(consistency.detect(seeded(spark, sf), only=["multiple_ages", "multiple_dates"]))


# Word edges are marked first (1 before, 2 after), since this engine's expressions have no look-around.
NAMED = rf"""list_transform(regexp_extract_all(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g'), '\x01[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\x02(?:[{SP}]+\x01[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\x02){{1,2}}'), lambda x: replace(replace(x, chr(1), ''), chr(2), ''))"""
COUNTED = rf"""list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_.])(\p{{Nd}})', '\1' || chr(1) || '\2', 'g'), '(?i)\x01(?:\p{{Nd}}{{1,3}}(?:,\x01?\p{{Nd}}{{3}})+|\p{{Nd}}+(?:\.\p{{Nd}}+)?)(?:[{SP}]*(?:%|percent|por ciento))?'), lambda x: replace(x, chr(1), '')))"""


@query("name_variant", f""", n AS (SELECT book_id, sent_seq, file, par, sent, unnest({NAMED}) AS name FROM sents),
 f AS (SELECT book_id, name, {FOLD.format("split_part(name, ' ', -1)")} AS surname, arg_min(struct_pack(file := file, par := par, sent := sent), sent_seq) AS f FROM n GROUP BY 1, 2)
 SELECT book_id, 'name_variant' AS code, f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence, 0.5::DOUBLE AS weight FROM (SELECT book_id, surname, arg_min(f, name) AS f FROM f GROUP BY 1, 2 HAVING count(*) > 1)""")
def _(spark, sf):
    return shown(consistency.detect(seeded(spark, sf), only=["name_variant"]))


@query("consistency_numbers", f""", v AS (SELECT *, {COUNTED} AS numbers FROM pars), c AS (SELECT *, len(list_filter(numbers, lambda x: regexp_matches(x, '%|percent|por ciento', 'i'))) AS percentages FROM v)
 SELECT book_id, code, file, par::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.5::DOUBLE AS weight FROM (SELECT *, 'multiple_numbers' AS code FROM c WHERE len(numbers) > 1 UNION ALL SELECT *, 'multiple_percentages' FROM c WHERE percentages > 1)""")
def _(spark, sf):
    return shown(consistency.detect(seeded(spark, sf), only=["multiple_numbers", "multiple_percentages"]))


# Repetition

def _eligible(rows: str) -> str:
    return f"elig AS (SELECT * FROM (SELECT *, {WORDS.format(FOLD.format('text'))} AS w FROM {rows}) WHERE len(w) >= 5), forms AS (SELECT *, array_to_string(w, ' ') AS norm FROM elig)"


SENT_ELIGIBLE = _eligible("sents")
PAR_ELIGIBLE = _eligible("(SELECT *, 0 AS sent, row_number() OVER (PARTITION BY book_id ORDER BY chapter_seq, par) AS sent_seq FROM pars)")


def _exact(label: str, base: str) -> None:
    @query(f"exact_{label}", f"WITH {PLAIN_BASE} , {base} SELECT book_id, 'exact_{label}' AS code, {PLACE}, 1.0::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY book_id, norm ORDER BY sent_seq) AS nth FROM forms) WHERE nth > 1", base=False)
    def _(spark, sf):
        s, p = repetition.eligible(seeded(spark, sf, seeds=False), 5)
        return shown(repetition.exact(s if label == "sentence" else p, label))


_exact("sentence", SENT_ELIGIBLE)
_exact("paragraph", PAR_ELIGIBLE)


def _similar(label: str, base: str, cap: int, threshold: float) -> None:
    sql = f""", {base}, u AS (SELECT book_id, norm, min(sent_seq) AS s, arg_min(struct_pack(file := file, par := par, sent := sent, w := w), sent_seq) AS f FROM forms GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY book_id) AS n FROM u),
    l AS (SELECT * FROM r WHERE r * (n - 1) - r * (r - 1) / 2 < {cap}),
    p AS (SELECT l.book_id, b.f, list_distinct(l.f.w) AS x, list_distinct(b.f.w) AS y FROM l JOIN r b ON l.book_id = b.book_id AND l.r < b.r AND l.r * (l.n - 1) - l.r * (l.r - 1) / 2 + b.r - l.r <= {cap} AND abs(len(l.f.w) - len(b.f.w)) <= greatest(2, len(l.f.w) // 3)),
    d AS (SELECT *, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS dice FROM p)
    SELECT book_id, 'similar_{label}' AS code, f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence, round(dice, 6) AS weight FROM d WHERE dice >= {threshold}"""

    @query(f"similar_{label}", sql)
    def _(spark, sf):
        s, p = repetition.eligible(seeded(spark, sf), 5)
        return shown(repetition.similar(s if label == "sentence" else p, label, threshold, cap)[0])


_similar("sentence", SENT_ELIGIBLE, 10_000, 0.45)
_similar("paragraph", PAR_ELIGIBLE, 10_000, 0.45)


@query("similarity_cap", f", {SENT_ELIGIBLE} SELECT book_id FROM (SELECT book_id, count(DISTINCT norm) AS n FROM forms GROUP BY 1) WHERE n * (n - 1) / 2 > 10000")
def _(spark, sf):
    return repetition.similar(repetition.eligible(seeded(spark, sf), 5)[0], "sentence", 0.85, 10_000)[1]


GRAMS = f"""{SENT_ELIGIBLE}, g AS (SELECT book_id, sent_seq, file, par, sent, k AS width, s, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, unnest([3, 4, 5, 6, 7, 8]) AS k FROM forms) WHERE len(w) >= k)),
o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sent_seq, width, s) AS o FROM g)"""


@query("repeated_ngrams", f""", {GRAMS}, k AS (SELECT * FROM o WHERE o <= 100000),
 t AS (SELECT book_id, width, phrase, min(o) AS first, arg_max(struct_pack(file := file, par := par, sent := sent), o) AS last, list_sort(list_slice(list(sent_seq ORDER BY o), 1, 2)) AS pair FROM k GROUP BY 1, 2, 3 HAVING count(DISTINCT sent_seq) > 1)
 SELECT book_id, 'ngram_' || width AS code, last.file AS file, last.par::BIGINT AS paragraph, last.sent::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY book_id, pair ORDER BY width DESC, first) AS nth FROM t) WHERE nth = 1""")
def _(spark, sf):
    return shown(repetition.phrases(repetition.eligible(seeded(spark, sf), 5)[0], 3, 8, 100_000)[0])


@query("ngram_cap", f", {SENT_ELIGIBLE} SELECT book_id FROM (SELECT book_id, sum(list_sum(list_transform([3, 4, 5, 6, 7, 8], lambda k: greatest(len(w) - k + 1, 0)))) AS n FROM forms GROUP BY 1) WHERE n > 100000")
def _(spark, sf):
    return repetition.phrases(repetition.eligible(seeded(spark, sf), 5)[0], 3, 8, 100_000)[1]


# Structure

NUMBERED = "CASE WHEN doc_id % 3 = 0 THEN 'Chapter ' || (doc_id // 20 + 1) WHEN doc_id % 3 = 1 THEN 'Chapter Introduction' ELSE 'Part ' || doc_id END"


# Shapes that all share but for the number, that some share, that none shares, and none.
HEADINGS = "CASE WHEN doc_id % 10 = 0 THEN filter(array('x'), h -> h = '') WHEN doc_id % 10 = 1 THEN array(concat('Part ', translate(doc_id, '0123456789', 'abcdefghij'))) WHEN doc_id % 10 < 5 THEN array(concat('Section ', doc_id), concat('HEADING ', doc_id % 7)) ELSE array(concat('Section ', doc_id), concat('Kind ', translate(doc_id % 3, '012', 'abc'))) END"
SHAPES = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'only ' || doc_id WHEN doc_id % 10 < 5 THEN 'numbered' ELSE 'kind ' || doc_id % 3 END"


def _chapters(spark, sf) -> Tables:
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    t = seeded(spark, sf)
    name = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    title = F.expr(NUMBERED.replace("doc_id // 20", "doc_id div 20"))
    chapters = rows.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_seq"), F.concat(name, F.lit(".txt")).alias("file"), title.alias("title"), F.when(F.col("doc_id") % 5 == 0, title).when(F.col("doc_id") % 5 == 1, "Contents").otherwise("").alias("toc_title"), F.expr(HEADINGS).alias("headings"))
    return Tables(t.books, t.metadata, chapters, t.paragraphs, t.sentences, t.resources)


@query("editorial_remnant", rf"SELECT book_id, 'editorial_remnant' AS code, file, par::BIGINT AS paragraph, 0::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM pars WHERE regexp_matches(text, '{B0}(?:todo|tbd|xxx|lorem ipsum|insert (?:text|image)|draft(?:ing)? note){B1}|待补充|占位符|草稿', 'i')")
def _(spark, sf):
    return shown(structure.detect(seeded(spark, sf), only=["editorial_remnant"]))


def _ends(code: str, pick: str, cut: str) -> None:
    sql = f""", e AS (SELECT book_id, chapter_seq, {pick}(struct_pack(file := file, par := par, sent := sent, text := text), sent_seq) AS f FROM sents GROUP BY 1, 2),
    k AS (SELECT *, array_to_string({cut.format(WORDS.format(FOLD.format('f.text')))}, ' ') AS key FROM e)
    SELECT book_id, '{code}' AS code, f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY book_id, key) AS n FROM k) WHERE n > 1"""

    @query(code, sql)
    def _(spark, sf):
        return shown(structure.detect(seeded(spark, sf), only=[code]))


_ends("repeated_chapter_start", "arg_min", "list_slice({}, 1, 8)")
_ends("repeated_chapter_end", "arg_max", "list_slice({}, -8, -1)")


@query("chapter_number_gap", f""", c AS (SELECT source AS book_id, doc_id, {NUMBERED} AS title FROM documents),
 n AS (SELECT *, nullif(regexp_extract(title, '^(?:chapter|chapitre|capítulo|第)\\s*([\\divxlcdm]+)', 1, 'i'), '') AS num FROM c),
 x AS (SELECT *, 1 + coalesce(sum((num IS NOT NULL)::INT) OVER (PARTITION BY book_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM n)
 SELECT book_id, 'chapter_number_gap' AS code, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM x WHERE regexp_matches(num, '^\\d+$') AND num::BIGINT <> expected""")
def _(spark, sf):
    return shown(structure.detect(_chapters(spark, sf), only=["chapter_number_gap"]))


@query("toc_title_issue", f""", c AS (SELECT source AS book_id, doc_id, {NUMBERED} AS title, CASE doc_id % 5 WHEN 0 THEN {NUMBERED} WHEN 1 THEN 'Contents' ELSE '' END AS toc FROM documents),
 n AS (SELECT *, row_number() OVER (PARTITION BY book_id, lower(toc) ORDER BY doc_id) AS nth FROM c WHERE toc <> '')
 SELECT book_id, 'toc_title_issue' AS code, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM n WHERE nth > 1 OR lower(toc) <> lower(title)""")
def _(spark, sf):
    return shown(structure.detect(_chapters(spark, sf), only=["toc_title_issue"]))


@query("repeated_heading_structure", f""", e AS (SELECT book_id, chapter_seq, arg_min(struct_pack(par := par, sent := sent), sent_seq) AS f FROM sents GROUP BY 1, 2),
 k AS (SELECT source AS book_id, doc_id, {SHAPES} AS shape FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY book_id, shape) AS n FROM k WHERE shape IS NOT NULL)
 SELECT n.book_id, 'repeated_heading_structure' AS code, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, coalesce(f.par, 0)::BIGINT AS paragraph, coalesce(f.sent, 0)::BIGINT AS sentence, 1.0::DOUBLE AS weight FROM n LEFT JOIN e ON e.book_id = n.book_id AND e.chapter_seq = n.doc_id WHERE n > 1""")
def _(spark, sf):
    return shown(structure.detect(_chapters(spark, sf), only=["repeated_heading_structure"]))


@query("low_vocabulary_diversity", f""", w AS (SELECT doc_id::VARCHAR AS book_id, file, unnest({WORDS.format(FOLD.format(norm('raw')))}) AS word FROM docs),
 d AS (SELECT book_id, any_value(file) AS file, count(DISTINCT word)::DOUBLE / count(*) AS d FROM w GROUP BY 1)
 SELECT book_id, 'low_vocabulary_diversity' AS code, file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, round(1 - d, 6) AS weight FROM d WHERE d < 0.35""")
def _(spark, sf):
    return shown(structure.detect(seeded(spark, sf, "doc_id"), only=["low_vocabulary_diversity"]))


@query("connector_density", f""", w AS (SELECT book_id, file, unnest({WORDS.format(FOLD.format('text'))}) AS word FROM pars),
 d AS (SELECT book_id, min(file) AS file, sum((word IN ('however', 'therefore', 'moreover', 'furthermore', 'additionally', 'meanwhile', 'nevertheless'))::INT)::DOUBLE / count(*) AS r FROM w GROUP BY 1)
 SELECT book_id, 'connector_density' AS code, file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, round(r, 6) AS weight FROM d""")
def _(spark, sf):
    return shown(structure.detect(seeded(spark, sf), {"structure": {"connector_ratio_threshold": 0.0}}, only=["connector_density"]))


# Images and metadata


def _images(spark, sf) -> Tables:
    t = seeded(spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    i = F.col("doc_id")
    resources = rows.select(F.col("source").alias("book_id"), i.cast("int").alias("res_seq"), F.concat(F.lit("img/"), F.when(i % 4 == 0, "img_").otherwise("figure-"), i.cast("string"), F.lit(".png")).alias("path"), F.lit("image/png").alias("media_type"), F.when(i % 6 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("size"), F.when(i % 9 == 0, "").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), (i % 2 == 0).alias("referenced"), F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, "").otherwise("alt").cast("string").alias("alt_text"), (i % 64).cast("int").alias("width"), F.lit(100).alias("height"))
    pos = F.when(F.col("book_id") == "src1", "rights").otherwise("title")
    meta = t.books.select("book_id", F.lit(0).alias("pos"), pos.alias("key"), F.lit("x").alias("value"))
    return Tables(t.books, meta, t.chapters, t.paragraphs, t.sentences, resources)


IMG = """, r AS (SELECT source AS book_id, doc_id, 'img/' || CASE WHEN doc_id % 4 = 0 THEN 'img_' ELSE 'figure-' END || doc_id || '.png' AS file, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sha256(text) END AS h, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars END AS size FROM documents),
 x AS (SELECT *, count(*) OVER (PARTITION BY book_id, h) AS copies FROM r),
 c AS (SELECT book_id, file, unnest(list_filter([CASE WHEN h <> '' AND copies > 1 THEN 'duplicate_image' END, CASE WHEN doc_id % 2 <> 0 THEN 'unused_image' END, CASE WHEN doc_id % 3 < 2 THEN 'missing_alt_text' END, CASE WHEN size <= 0 THEN 'missing_size' END, CASE WHEN h = '' THEN 'missing_hash' END, CASE WHEN doc_id % 4 = 0 THEN 'generic_filename_weak' END, CASE WHEN doc_id % 64 < 32 THEN 'small_dimensions' END], lambda v: v IS NOT NULL)) AS code FROM x
 UNION ALL SELECT book_id, arg_min(file, doc_id), 'missing_image_license_context' FROM r WHERE book_id <> 'src1' GROUP BY 1)
 SELECT book_id, code, file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.5::DOUBLE AS weight FROM c"""


@query("image_findings", IMG)
def _(spark, sf):
    return shown(images.detect(_images(spark, sf)))


@query("no_images_inventory", "SELECT book_id, 'no_images_inventory' AS code, min(file) AS file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.2::DOUBLE AS weight FROM docs GROUP BY 1")
def _(spark, sf):
    return shown(images.detect(seeded(spark, sf)))


META_SQL = """VALUES (0, 'title', 'The Book'), (1, 'dc:title', CASE WHEN doc_id % 2 = 0 THEN 'The  book' ELSE 'Another' END), (2, 'author', CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'A. Writer' END), (3, 'creator', CASE WHEN doc_id % 4 = 0 THEN 'B. Writer' ELSE 'a. writer' END), (4, 'generator', CASE WHEN doc_id % 5 = 0 THEN 'Tool' ELSE ' ' END)"""


def _meta(spark, sf) -> Tables:
    t = seeded(spark, sf, "doc_id")
    i = F.col("book_id").cast("long")
    pairs = [("title", F.lit("The Book")), ("dc:title", F.when(i % 2 == 0, "The  book").otherwise("Another")), ("author", F.when(i % 3 == 0, "").otherwise("A. Writer")), ("creator", F.when(i % 4 == 0, "B. Writer").otherwise("a. writer")), ("generator", F.when(i % 5 == 0, "Tool").otherwise(" "))]
    rows = t.books.select("book_id", F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(k).alias("key"), v.alias("value")) for n, (k, v) in enumerate(pairs)])).alias("m")).select("book_id", "m.*")
    chapters = t.chapters.withColumn("title", F.when(i % 7 == 0, "The Book: Part One").otherwise(F.col("title")))
    return Tables(t.books, rows, chapters, t.paragraphs, t.sentences, t.resources)


@query("metadata_findings", """, c AS (SELECT doc_id::VARCHAR AS book_id, file, unnest(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'title_display_variant' END, CASE WHEN doc_id % 2 <> 0 THEN 'title_metadata_variant' END,
 CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'author_metadata_variant' END, CASE WHEN doc_id % 5 = 0 THEN 'generator_metadata' END, 'missing_language', 'missing_identifier'], lambda v: v IS NOT NULL)) AS code FROM docs)
 SELECT book_id, code, file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.5::DOUBLE AS weight FROM c""")
def _(spark, sf):
    return shown(metadata.detect(_meta(spark, sf)))


@query("metadata_missing", """SELECT doc_id::VARCHAR AS book_id, 'missing_' || field AS code, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, 0::BIGINT AS paragraph, 0::BIGINT AS sentence, 0.5::DOUBLE AS weight
 FROM documents, (SELECT unnest(['title', 'creator', 'language', 'identifier']) AS field) WHERE NOT (field = 'title' AND doc_id % 2 = 0 OR field = 'creator' AND doc_id % 3 = 0 OR field = 'language' AND doc_id % 5 > 0 OR field = 'identifier' AND doc_id % 2 = 1)""", base=False)
def _(spark, sf):
    t = seeded(spark, sf, "doc_id")
    i = F.col("book_id").cast("long")
    pairs = [("DC.Title", F.when(i % 2 == 0, "T").otherwise("  ")), ("author", F.when(i % 3 == 0, "A").otherwise("")), ("language", F.when(i % 5 > 0, "xx").otherwise("\u00a0")), ("identifier", F.when(i % 2 == 1, "urn:1"))]
    rows = t.books.select("book_id", F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(k).alias("key"), v.alias("value")) for n, (k, v) in enumerate(pairs)])).alias("m")).select("book_id", "m.*")
    return shown(metadata.detect(Tables(t.books, rows.where("value is not null"), t.chapters, t.paragraphs, t.sentences, t.resources)))


# After detection

SIGNALS = f""", {CITE_BASE}, raw_found AS ({CITE_SQL} UNION ALL SELECT book_id, code, {PLACE}, 1.0::DOUBLE FROM (SELECT *, {RESIDUE_SQL} AS code FROM sents) WHERE code IS NOT NULL),
 found AS (SELECT *, CASE WHEN weight = 1 THEN 'chatbot_residue' ELSE 'citations' END AS category, CASE WHEN code IN ('doi_present', 'url_present', 'citation_present') THEN 'low' ELSE 'medium' END AS severity FROM raw_found)"""


def _signals(spark, sf) -> tuple[Tables, DataFrame]:
    """Findings of two detectors, which read only the sentences that may have any; these are cut from the text once."""
    t, rules = seeded(spark, sf), load_rules()
    few = replace(t, sentences=settled(t.sentences.where(residue.may_match(rules) | citations.may_match()), "signal-sentences"))
    return t, residue.detect(few, rules).unionByName(citations.detect(few))


@query("exclusions", f"{SIGNALS} SELECT code, count(*) AS n FROM found WHERE NOT (file LIKE '0000001%.txt' OR file = '00000020.txt') GROUP BY 1")
def _(spark, sf):
    rules = load_rules({"exclusions": {"file_globs": ["0000001*.txt"], "files": ["00000020.txt"]}})
    return _signals(spark, sf)[1].where(~post.excluded(rules)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_findings", f"{SIGNALS} SELECT book_id, code, file, paragraph, sentence, weight FROM found")
def _(spark, sf):
    found = _signals(spark, sf)[1]
    return shown(post.deduplicated(found.unionByName(found.withColumn("weight", F.col("weight") / 2))))


@query("finding_ids", rf""", f AS (SELECT *, {RESIDUE_SQL} AS code FROM sents) SELECT book_id, file, par::BIGINT AS paragraph, sent::BIGINT AS sentence, left(sha256(concat_ws(chr(31), 'chatbot_residue', code, file, chapter, par::VARCHAR, sent::VARCHAR, left(text, 300),
 CASE code WHEN 'as an ai' THEN 'First-person system disclaimer' WHEN 'cannot comply' THEN 'Conversational refusal' WHEN 'template marker' THEN 'Unresolved template marker' WHEN 'configured_phrase' THEN 'Configured conversational phrase' WHEN 'assistant label' THEN 'Conversation role label' ELSE 'Instruction-like wording' END || '; review whether it belongs in reader-facing prose.')), 16) AS id FROM f WHERE code IS NOT NULL""")
def _(spark, sf):
    found = post.identified(post.deduplicated(residue.detect(seeded(spark, sf), load_rules())))
    return found.select("book_id", "file", F.col("paragraph").cast("long").alias("paragraph"), F.col("sentence").cast("long").alias("sentence"), "id")


SCORES = f"""{SIGNALS}, cats AS (SELECT book_id, c.k AS category, c.w AS cw FROM (SELECT DISTINCT book_id FROM docs), (SELECT unnest([{{'k': 'chatbot_residue', 'w': 0.18::DOUBLE}}, {{'k': 'repetition', 'w': 0.14::DOUBLE}}, {{'k': 'style_patterns', 'w': 0.10::DOUBLE}}, {{'k': 'structure', 'w': 0.12::DOUBLE}}, {{'k': 'citations', 'w': 0.12::DOUBLE}}, {{'k': 'consistency', 'w': 0.12::DOUBLE}}, {{'k': 'images', 'w': 0.12::DOUBLE}}, {{'k': 'metadata', 'w': 0.10::DOUBLE}}]) AS c)),
 scores AS (SELECT c.book_id, c.category, any_value(c.cw) AS cw, least(100.0::DOUBLE, coalesce(sum(f.weight), 0) / 10 * 100) AS score FROM cats c LEFT JOIN found f ON f.book_id = c.book_id AND f.category = c.category GROUP BY 1, 2)"""


def _scores(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, found = _signals(spark, sf)
    found = settled(post.deduplicated(found), "findings")
    scores = scoring.category_scores(found, t.books, load_rules())
    return found, scores, scoring.summaries(found, scores, post.resolve_language(t), load_rules())


@query("category_scores", f"{SCORES} SELECT book_id, category, round(score, 6) AS score FROM scores")
def _(spark, sf):
    return _scores(spark, sf)[1].withColumn("score", F.round("score", 6))


@query("overall_risk", f"""{SCORES}, t AS (SELECT book_id, sum(score * cw) AS total FROM scores GROUP BY 1), n AS (SELECT book_id, count(*) AS n, max(severity) AS top FROM found GROUP BY 1)
 SELECT t.book_id, coalesce(n, 0)::BIGINT AS finding_count, round(total, 6) AS overall_score, CASE WHEN total < 30 THEN '낮은 위험' WHEN total < 60 THEN '추가 자료 확인 필요' WHEN total < 80 THEN '사람 검토 필요' ELSE '우선 검토 필요' END AS risk_level, 'en' AS language, coalesce(top, 'none') AS highest_finding_severity FROM t LEFT JOIN n USING (book_id)""")
def _(spark, sf):
    return _scores(spark, sf)[2].select("book_id", F.col("finding_count").cast("long").alias("finding_count"), F.round("overall_score", 6).alias("overall_score"), "risk_level", "language", "highest_finding_severity")


@query("finding_counts", f"""{SIGNALS} SELECT book_id, 'severity' AS "by", severity AS value, count(*) AS n FROM found GROUP BY ALL UNION ALL SELECT book_id, 'category', category, count(*) FROM found GROUP BY ALL UNION ALL SELECT book_id, 'chapter', replace(file, '.txt', ''), count(*) FROM found GROUP BY ALL""")
def _(spark, sf):
    return scoring.finding_counts(_signals(spark, sf)[1])


@query("compare_books", f"""{SCORES}, b AS (SELECT book_id, category, score FROM scores UNION ALL SELECT book_id, 'overall', sum(score * cw) FROM scores GROUP BY 1) SELECT category, round(max(CASE WHEN book_id = 'src1' THEN score END) - max(CASE WHEN book_id = 'src0' THEN score END), 6) AS score_delta FROM b GROUP BY 1""")
def _(spark, sf):
    _, scores, summary = _scores(spark, sf)
    return compared(scores, summary, "src0", "src1").withColumn("score_delta", F.round("score_delta", 6))


@query("finding_search", f"{SIGNALS} SELECT book_id, code, file, paragraph, sentence, weight FROM found JOIN sents USING (book_id, file) WHERE severity = 'medium' AND category = 'citations' AND par = paragraph AND sent = sentence AND (lower(left(text, 300)) LIKE '%readers%' OR code IN ('x'))")
def _(spark, sf):
    return shown(search(_signals(spark, sf)[1], category="citations", severity="medium", text="READERS"))


CITE_ACTION_KO = post.ACTIONS_KO[citations.ACTION]


@query("localized_findings", f""", {CITE_BASE}, found AS ({CITE_SQL}), p AS (SELECT f.*, left(s.text, 160) AS start FROM found f JOIN sents s ON s.book_id = f.book_id AND s.file = f.file AND s.par = f.paragraph AND s.sent = f.sentence)
 SELECT book_id, code, file, paragraph, sentence, '{CITE_ACTION_KO}' AS review_action, md5('인용 및 출처 검토 신호입니다. 탐지 규칙: ' || code || CASE code WHEN 'source_needed_marker' THEN '; 감지된 출처 표지: source-needed marker' ELSE '' END || '; 원문 일부: ' || start || '. 원문의 수치, 값 및 출처 문맥을 확인하세요.') AS reason FROM p""")
def _(spark, sf):
    t = seeded(spark, sf)
    found = post.localized(citations.detect(t), post.resolve_language(t, "ko"))
    return found.select("book_id", "code", "file", F.col("paragraph").cast("long").alias("paragraph"), F.col("sentence").cast("long").alias("sentence"), "review_action", F.md5(F.col("reason").cast("binary")).alias("reason"))


# Declared languages of three kinds; Hangul at the start, at the end (which counts only early enough), or nowhere.
SPOKEN = "CASE doc_id % 4 WHEN 0 THEN '한국. ' || text WHEN 1 THEN text || ' 끝 한국어' ELSE text END"


@query("language_resolution", f"""WITH {own_base(SPOKEN, "doc_id::VARCHAR")}, t AS (SELECT book_id, string_agg(text, ' ' ORDER BY sent_seq) AS t FROM sents GROUP BY 1)
 SELECT docs.book_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 6 <> 1 AND regexp_matches(left(coalesce(t, ''), 10000), '[가-힣]') THEN 'ko' ELSE 'en' END AS language FROM docs LEFT JOIN t USING (book_id)""", base=False)
def _(spark, sf):
    t = seeded(spark, sf, "doc_id", seeds=SPOKEN)
    i = F.col("book_id").cast("long") % 6
    declared = t.books.select("book_id", F.lit(0).alias("pos"), F.lit("language").alias("key"), F.when(i == 0, "KO_kr").when(i == 1, "EN-gb").when(i == 2, "fr").alias("value")).where("value is not null")
    return post.resolve_language(Tables(t.books, declared, t.chapters, t.paragraphs, t.sentences, t.resources))


@query("link_candidates", r""", u AS (SELECT book_id, sent_seq, file, unnest(list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>\])}]+'), lambda x, i: {'x': x, 'i': i})) AS u FROM sents),
 f AS (SELECT book_id, u.x AS url, min(struct_pack(s := sent_seq, i := u.i, file := file)) AS f FROM u GROUP BY 1, 2)
 SELECT book_id, url, f.file AS file FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f.s, f.i) AS n FROM f) WHERE n <= 100""")
def _(spark, sf):
    return links.candidates(seeded(spark, sf), 100).select("book_id", "url", "file")


# Sources


def _package(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text")
    path = F.concat(F.lit("OPS/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".xhtml"))
    media = F.when(F.col("doc_id") % 3 == 0, "image/png").otherwise("application/xhtml+xml")
    manifest = rows.select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("seq"), F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("id"), path.alias("path"), media.alias("media"), (F.col("doc_id") % 30 == 0).alias("cover"))
    spine = manifest.where("media <> 'image/png'").select("book_id", "seq", "id")
    return rows, manifest, spine


@query("spine_join", "SELECT book_id, doc_id::BIGINT AS seq, 'OPS/' || doc_id || '.xhtml' AS path FROM docs WHERE doc_id % 3 <> 0")
def _(spark, sf):
    _, manifest, spine = _package(spark, sf)
    return spine_chapters(spine, manifest, manifest.select("book_id", "path"), manifest.select("book_id", "path")).select("book_id", F.col("seq").cast("long").alias("seq"), "path")


@query("resource_references", """SELECT book_id, 'OPS/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.xhtml' END AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id % 30 = 0 OR doc_id % 6 = 0 ELSE true END AS referenced, CASE WHEN doc_id % 6 = 0 THEN 'alt' END AS alt_text FROM docs""")
def _(spark, sf):
    _, manifest, spine = _package(spark, sf)
    resources = manifest.select("book_id", "seq", "path", F.lit(1).cast("long").alias("size"), F.lit("").alias("sha256"))
    refs = manifest.where("seq % 6 = 0").select("book_id", "path", F.explode(F.array(F.lit(None).cast("string"), F.lit("alt"))).alias("alt"), F.col("seq").alias("nth"))
    return resource_references(resources, manifest, spine, refs).select("book_id", "path", "referenced", "alt_text")


@query("long_sentence_risk", f", {STYLE_BASE}, t AS (SELECT book_id, sum(CASE WHEN len(w) > 40 THEN len(w) / 40.0::DOUBLE ELSE 0 END) AS s FROM measured GROUP BY 1) SELECT book_id, round(least(100.0::DOUBLE, s * 10) * 0.10, 6) AS overall_score FROM t")
def _(spark, sf):
    t = seeded(spark, sf)
    found = post.identified(post.deduplicated(style.detect(t, only=["long_sentence"])))
    scores = scoring.category_scores(found, t.books, load_rules())
    return scores.groupBy("book_id").agg(F.round(scoring.total_score(load_rules()), 6).alias("overall_score"))
