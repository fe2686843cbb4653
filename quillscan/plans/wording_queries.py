"""Named queries over wording: repetition without budgets, long phrase lists, and the whole text of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillscan.functions.phrases import phrases_in
from quillscan.operators import citations, consistency, images, metadata, repeats, repetition, residue, structure, style
from quillscan.plans import post
from quillscan.plans.queries import _chapters, _eligible, _images, _meta, BASE, CHAPTER_PLACE, CITE_BASE, COUNTED, FOLD, HEADINGS, NAMED, NUMBERED, PAR_ELIGIBLE, PLACE, PLAIN_BASE, SENT_ELIGIBLE, SHAPES, STYLE_BASE, WORDS, B0, B1, own_base, query, seeded, shown
from quillscan.plans.rules import load_rules
from quillscan.plans.source_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

# A sentence in every document that differs from others in one word, in several, or in none; and a paragraph that does.
NEAR = "text || ' The keeper of the old tower at lot' || CAST(doc_id % 7 AS STRING) || ' walked slowly along the high wall towards the north gate on day' || CAST(doc_id % 40 AS STRING) || '.' || chr(10) || chr(10) || 'Every one of the ' || repeat('very ', CAST(doc_id % 3 AS INT)) || 'long rows in this garden was planted by hand in spring and tended by word' || CAST(doc_id % 9 AS STRING) || ' until the autumn'"
NEAR_SQL = NEAR.replace("CAST(doc_id % 7 AS STRING)", "(doc_id % 7)::VARCHAR").replace("CAST(doc_id % 40 AS STRING)", "(doc_id % 40)::VARCHAR").replace("CAST(doc_id % 9 AS STRING)", "(doc_id % 9)::VARCHAR").replace("CAST(doc_id % 3 AS INT)", "doc_id % 3")
NEAR_BASE = own_base(NEAR_SQL)


# Repetition without budgets


def _similar_all(label: str, base: str) -> None:
    sql = f"""WITH {NEAR_BASE}, {base}, u AS (SELECT book_id, norm, min(sent_seq) AS s, arg_min(struct_pack(file := file, par := par, sent := sent, n := len(w)), sent_seq) AS f, list_distinct(any_value(w)) AS d FROM forms GROUP BY 1, 2),
    p AS (SELECT b.book_id, b.f, 2.0::DOUBLE * len(list_intersect(a.d, b.d)) / (len(a.d) + len(b.d)) AS dice FROM u a JOIN u b ON a.book_id = b.book_id AND a.s < b.s AND abs(a.f.n - b.f.n) <= greatest(2, a.f.n // 3) AND 2 * least(len(a.d), len(b.d)) >= 0.85::DOUBLE * (len(a.d) + len(b.d)))
    SELECT book_id, 'similar_{label}' AS code, f.file AS file, f.par::BIGINT AS paragraph, f.sent::BIGINT AS sentence, round(dice, 6) AS weight FROM p WHERE dice >= 0.85::DOUBLE"""

    @query(f"similar_{label}_all", sql, base=False)
    def _(spark, sf):
        s, p = repetition.eligible(seeded(spark, sf, seeds=NEAR), 5)
        return shown(repetition.similar_all(s if label == "sentence" else p, label, 0.85))


_similar_all("sentence", SENT_ELIGIBLE)
_similar_all("paragraph", PAR_ELIGIBLE)


@query("repeated_5grams", f"""WITH {PLAIN_BASE}, {SENT_ELIGIBLE} SELECT book_id, array_to_string(w[s:s + 4], ' ') AS phrase, count(*) AS n FROM (SELECT book_id, w, unnest(range(1, len(w) - 3)) AS s FROM forms) GROUP BY 1, 2 HAVING count(*) > 1""", base=False)
def _(spark, sf):
    return repeats.repeated_phrases(repetition.eligible(seeded(spark, sf, seeds=False), 5)[0], 5)


# Widths grow by one as long as a phrase is repeated; a maximal one loses occurrences on either side. Too slow on whole
# tables, so that only tests run it.
REPEATS = f"""WITH RECURSIVE {PLAIN_BASE}, {SENT_ELIGIBLE}, t AS (SELECT book_id, sent_seq, file, par, sent, w, len(w) AS m FROM forms),
 g AS (SELECT book_id, sent_seq, s, 3 AS k, md5(array_to_string(w[s:s + 2], ' ')) AS h, count(*) OVER (PARTITION BY book_id, md5(array_to_string(w[s:s + 2], ' '))) AS n FROM (SELECT *, unnest(range(1, m - 1)) AS s FROM t)
  UNION ALL
  SELECT book_id, sent_seq, s, k, h, count(*) OVER (PARTITION BY book_id, h) AS n FROM (SELECT g.book_id, g.sent_seq, g.s, g.k + 1 AS k, md5(g.h || t.w[g.s + g.k]) AS h FROM g JOIN t USING (book_id, sent_seq) WHERE g.n > 1 AND g.s + g.k <= t.m)),
 o AS (SELECT g.*, CASE WHEN g.s > 1 THEN t.w[g.s - 1] END AS before, CASE WHEN g.s + g.k <= t.m THEN t.w[g.s + g.k] END AS after FROM g JOIN t USING (book_id, sent_seq) WHERE n > 1),
 f AS (SELECT book_id, k, h, count(*) AS n, min(struct_pack(q := sent_seq, s := s)) AS a, max(struct_pack(q := sent_seq, s := s)) AS z FROM o GROUP BY 1, 2, 3 HAVING (bool_or(before IS NULL) OR min(before) <> max(before)) AND (bool_or(after IS NULL) OR min(after) <> max(after)))
 SELECT f.book_id, k::BIGINT AS width, f.n, t.file, t.par::BIGINT AS paragraph, t.sent::BIGINT AS sentence, a.s - 1 AS position, u.file AS last_file, u.par::BIGINT AS last_paragraph, u.sent::BIGINT AS last_sentence, z.s - 1 AS last_position, md5(array_to_string(t.w[a.s:a.s + k - 1], ' ')) AS phrase
 FROM f JOIN t ON t.book_id = f.book_id AND t.sent_seq = a.q JOIN t u ON u.book_id = f.book_id AND u.sent_seq = z.q"""


@query("maximal_repeats")
def _(spark, sf):
    found = repeats.maximal_repeats(repetition.eligible(seeded(spark, sf, seeds=False), 5)[0], 3)
    place = lambda end: F.concat(F.lpad(F.col(f"{end}.ord.chapter_seq").cast("string"), 8, "0"), F.lit(".txt"))
    long_ = lambda name: F.col(name).cast("long")
    return found.select(
        "book_id", long_("width").alias("width"), "n", place("first").alias("file"), long_("first.ord.par").alias("paragraph"), long_("first.ord.sent").alias("sentence"), long_("first.pos").alias("position"),
        place("last").alias("last_file"), long_("last.ord.par").alias("last_paragraph"), long_("last.ord.sent").alias("last_sentence"), long_("last.pos").alias("last_position"), F.md5(F.col("phrase").cast("binary")).alias("phrase"),
    )


# Long lists of phrases: every piece of 24 characters of the passages


PIECES = "SELECT DISTINCT phrase FROM (SELECT substr(text, i, 24) AS phrase FROM (SELECT text, unnest(range(1, length(text) - 22, 24)) AS i FROM benchmark))"


def _pieces(spark, sf) -> list[str]:
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length("text") >= 24)
    starts = F.sequence(F.lit(1), F.length("text") - 23, F.lit(24))
    return sorted(r[0] for r in rows.select(F.explode(F.transform(starts, lambda i: F.substring("text", i, F.lit(24))))).distinct().collect())


@query("phrase_hits", f"WITH phrases AS ({PIECES}) SELECT doc_id, count(*) AS n, md5(string_agg(phrase, chr(31) ORDER BY phrase)) AS phrases FROM documents JOIN phrases ON contains(lower(text), lower(phrase)) GROUP BY doc_id", base=False)
def _(spark, sf):
    pieces = _pieces(spark, sf)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("text"))
    found = rows.select("doc_id", phrases_in(spark, F.col("text"), pieces).alias("p")).where(F.size("p") > 0)
    names = spark.createDataFrame(list(enumerate(pieces)), "i int, phrase string")
    hits = found.select("doc_id", F.explode("p").alias("i")).join(names, "i").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("phrase")).alias("p"))
    return hits.select("doc_id", "n", F.md5(F.array_join("p", "\u001f").cast("binary")).alias("phrases"))


@query("residue_phrase_list", f", phrases AS ({PIECES}) SELECT book_id, 'configured_phrase' AS code, {PLACE}, 1.0::DOUBLE AS weight FROM sents WHERE EXISTS (SELECT 1 FROM phrases WHERE contains(lower(sents.text), lower(phrase)))")
def _(spark, sf):
    return shown(residue.detect(seeded(spark, sf), {"chatbot_residue": {"patterns": [], "phrases": _pieces(spark, sf)}}))


# The whole text of findings: the id is made of category, code, place, excerpt and reason


def _texts(name: str, category: str, rows: str, action: str, base: str, found) -> None:
    """``rows`` is SQL that gives book_id, severity, code, file, chapter, par, sent, text (of which the excerpt is cut) and reason."""
    sql = f"""WITH {base} SELECT DISTINCT book_id, code, severity, left(sha256(concat_ws(chr(31), '{category}', code, file, chapter, par::VARCHAR, sent::VARCHAR, left(text, 300), reason)), 16) AS id, md5(left(text, 300)) AS excerpt, md5(reason) AS reason, '{action}' AS review_action FROM ({rows})"""

    @query(f"texts_{name}", sql, base=False)
    def _(spark, sf):
        told = post.identified(post.deduplicated(found(spark, sf)))
        return told.select("book_id", "code", "severity", "id", F.md5(F.col("excerpt").cast("binary")).alias("excerpt"), F.md5(F.col("reason").cast("binary")).alias("reason"), "review_action")


HERE = "file, chapter, par, sent, text"
CITED = [
    ("source_needed_marker", "medium", "c1", "The text includes a source-needed marker; review whether a citation should be supplied."),
    ("malformed_doi", "medium", "c2", "A DOI is explicitly marked but does not match the expected DOI format; review the reference text."),
    ("doi_present", "low", "c3", "A DOI appears in running text; review its formatting and whether its reference details are complete."),
    ("empty_url", "medium", "c4", "A URL scheme has no host value; review whether a complete source link should be supplied."),
    ("placeholder_url", "medium", "c5", "A URL contains placeholder text or a documentation-only host; review the intended source link."),
    ("url_present", "low", "c6", "A URL appears in running text; review its presentation and supporting reference context."),
    ("citation_present", "low", "c7", "An inline citation-like pattern appears; review its consistency with the book’s citation style."),
    ("uncited_statistic_candidate", "medium", "c8 AND NOT (c3 OR c6 OR c7)", "A quantitative claim has no nearby inline citation pattern; review whether context or a source should accompany it."),
]
_texts("citations", "citations", " UNION ALL ".join(f"SELECT book_id, '{s}' AS severity, '{c}' AS code, {HERE}, '{r}' AS reason FROM cited WHERE {when}" for c, s, when, r in CITED), "Review the surrounding claim and add, correct, or document an appropriate source where needed.", f"{BASE}, {CITE_BASE}", lambda spark, sf: citations.detect(seeded(spark, sf)))

_texts("style", "style_patterns", f"""SELECT book_id, 'low' AS severity, 'long_sentence' AS code, {HERE}, 'Sentence has ' || len(w) || ' words, above configured review threshold 40.' AS reason FROM measured WHERE len(w) > 40
 UNION ALL SELECT book_id, 'low', 'punctuation_density', {HERE}, 'Punctuation density is above the configured review threshold.' FROM measured WHERE len(w) > 0 AND marks::DOUBLE / greatest(length(text), 1) > 0.18
 UNION ALL SELECT c.book_id, 'low', code, file, chapter, par, sent, text, said FROM (SELECT book_id, chapter_seq, f.par AS par, f.sent AS sent, unnest(list_filter([CASE WHEN passives::DOUBLE / n >= 0.02 THEN {{'code': 'passive_distribution', 'said': passives || '/' || n || ' sentences match a passive-voice heuristic.'}} END, CASE WHEN words > 0 AND nominals::DOUBLE / words >= 0.01 THEN {{'code': 'nominalization_distribution', 'said': nominals || '/' || words || ' words match nominalization endings.'}} END], lambda x: x IS NOT NULL), recursive := true) FROM chapters) c JOIN (SELECT book_id, chapter_seq, par, sent, file, chapter, text FROM sents) USING (book_id, chapter_seq, par, sent)""",
    "Review this pattern in context and revise only where it affects readability or voice.", f"{BASE}, {STYLE_BASE}", lambda spark, sf: style.detect(seeded(spark, sf), {"style_patterns": {"passive_ratio_threshold": 0.02, "nominal_ratio_threshold": 0.01}}))

_texts("consistency", "consistency", f"""SELECT v.book_id, 'medium' AS severity, x.code AS code, v.file, v.chapter, v.par, 0 AS sent, s.text, x.reason AS reason FROM v JOIN sents s ON s.book_id = v.book_id AND s.chapter_seq = v.chapter_seq AND s.par = v.par AND s.sent = 0, (SELECT unnest([1, 2, 3, 4]) AS k),
 LATERAL (SELECT CASE k WHEN 1 THEN 'multiple_ages' WHEN 2 THEN 'multiple_dates' WHEN 3 THEN 'multiple_percentages' ELSE 'multiple_numbers' END AS code,
  CASE WHEN k = 1 AND len(ages) > 1 THEN 'This paragraph contains multiple age expressions (' || array_to_string(list_sort(ages), ', ') || '); this is a review signal, not a factual-error claim.' WHEN k = 2 AND len(dates) > 1 THEN 'This paragraph contains multiple date expressions (' || array_to_string(list_sort(dates), ', ') || '); this is a review signal, not a factual-error claim.'
  WHEN k = 3 AND percentages > 1 THEN 'Multiple percentage expressions occur in one paragraph; review their denominator and context.' WHEN k = 4 AND len(numbers) > 1 THEN 'Multiple numeric expressions occur in one paragraph; review whether their units and references are clear.' END AS reason) x WHERE x.reason IS NOT NULL
 UNION ALL SELECT book_id, 'medium', 'name_variant', f.file, f.chapter, f.par, f.sent, f.text, 'Names sharing the surname “' || surname || '” use multiple full-name forms (' || array_to_string(names, ', ') || '); review whether they identify the same person.' FROM variants""",
    "Compare the referenced passages and confirm the intended value or wording.", rf"""{BASE}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '\d{{1,3}}\s*(?:years? old|años?)')) AS ages, list_distinct(regexp_extract_all(lower(text), '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|may\s+\d{{1,2}},?\s+\d{{4}}')) AS dates, {COUNTED} AS numbers FROM pars),
 v AS (SELECT *, len(list_filter(numbers, lambda x: regexp_matches(x, '%|percent|por ciento', 'i'))) AS percentages FROM w), n AS (SELECT book_id, sent_seq, file, chapter, par, sent, text, unnest({NAMED}) AS name FROM sents),
 firsts AS (SELECT book_id, name, {FOLD.format("split_part(name, ' ', -1)")} AS surname, arg_min(struct_pack(file := file, chapter := chapter, par := par, sent := sent, text := text), sent_seq) AS f FROM n GROUP BY 1, 2),
 variants AS (SELECT book_id, surname, list(name ORDER BY name) AS names, arg_min(f, name) AS f FROM firsts GROUP BY 1, 2 HAVING count(*) > 1)""", lambda spark, sf: consistency.detect(seeded(spark, sf)))  # fmt: skip

_texts("structure", "structure", f"""SELECT p.book_id, 'medium' AS severity, 'editorial_remnant' AS code, p.file, p.chapter, p.par, 0 AS sent, coalesce(s.text, p.text) AS text, 'Possible editorial placeholder or drafting note.' AS reason FROM pars p LEFT JOIN sents s ON s.book_id = p.book_id AND s.chapter_seq = p.chapter_seq AND s.par = p.par AND s.sent = 0 WHERE regexp_matches(p.text, '{B0}(?:todo|tbd|xxx|lorem ipsum|insert (?:text|image)|draft(?:ing)? note){B1}|待补充|占位符|草稿', 'i')
 UNION ALL SELECT book_id, 'medium', 'repeated_chapter_start', file, title, a.par, a.sent, a.text, 'Opening phrase is repeated across chapters.' FROM (SELECT *, count(*) OVER (PARTITION BY book_id, opening) AS n FROM ends) WHERE n > 1
 UNION ALL SELECT book_id, 'medium', 'repeated_chapter_end', file, title, z.par, z.sent, z.text, 'Closing phrase is repeated across chapters.' FROM (SELECT *, count(*) OVER (PARTITION BY book_id, closing) AS n FROM ends) WHERE n > 1
 UNION ALL SELECT book_id, 'medium', 'repeated_heading_structure', file, title, coalesce(a.par, 0), coalesce(a.sent, 0), coalesce(a.text, title), 'Heading structure is repeated across chapters.' FROM (SELECT c.*, a, count(*) OVER (PARTITION BY c.book_id, c.shape) AS n FROM chapters c LEFT JOIN ends e ON e.book_id = c.book_id AND e.chapter_seq = c.chapter_seq WHERE c.shape IS NOT NULL) WHERE n > 1
 UNION ALL SELECT book_id, 'medium', 'chapter_number_gap', file, title, 0, 0, title, 'Chapter numbering expected ' || expected || ', found ' || num || '.' FROM (SELECT *, 1 + coalesce(sum((num IS NOT NULL)::INT) OVER (PARTITION BY book_id ORDER BY chapter_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM chapters) WHERE regexp_matches(num, '^\\d+$') AND num::BIGINT <> expected
 UNION ALL SELECT book_id, 'medium', 'toc_title_issue', file, title, 0, 0, title, 'TOC title is duplicate or differs from the chapter title.' FROM (SELECT *, row_number() OVER (PARTITION BY book_id, lower(toc) ORDER BY chapter_seq) AS nth FROM chapters WHERE toc <> '') WHERE nth > 1 OR lower(toc) <> lower(title)
 UNION ALL SELECT book_id, 'medium', code, file, title, 0, 0, title, said FROM (SELECT book_id, unnest([{{'code': 'low_vocabulary_diversity', 'said': 'Book vocabulary diversity is ' || round_even(d * 100, 0)::INT || '%.'}}, {{'code': 'connector_density', 'said': 'Connector words account for ' || round_even(r * 100, 1)::DECIMAL(38, 1) || '% of words.'}}], recursive := true) FROM vocabulary) JOIN (SELECT book_id, arg_min(file, chapter_seq) AS file, arg_min(title, chapter_seq) AS title FROM chapters GROUP BY 1) USING (book_id)""",
    "Check the book structure and revise the source or navigation metadata as needed.", f"""{BASE}, chapters AS (SELECT source AS book_id, doc_id AS chapter_seq, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS file, {NUMBERED} AS title, CASE doc_id % 5 WHEN 0 THEN {NUMBERED} WHEN 1 THEN 'Contents' ELSE '' END AS toc, {SHAPES} AS shape, nullif(regexp_extract({NUMBERED}, '^(?:chapter|chapitre|capítulo|第)\\s*([\\divxlcdm]+)', 1, 'i'), '') AS num FROM documents),
 edges AS (SELECT book_id, chapter_seq, arg_min(struct_pack(par := par, sent := sent, text := text), sent_seq) AS a, arg_max(struct_pack(par := par, sent := sent, text := text), sent_seq) AS z FROM sents GROUP BY 1, 2),
 ends AS (SELECT c.*, a, z, array_to_string(list_slice({WORDS.format(FOLD.format('a.text'))}, 1, 8), ' ') AS opening, array_to_string(list_slice({WORDS.format(FOLD.format('z.text'))}, -8, -1), ' ') AS closing FROM chapters c JOIN edges USING (book_id, chapter_seq)),
 words AS (SELECT book_id, unnest({WORDS.format(FOLD.format('text'))}) AS word FROM pars), vocabulary AS (SELECT book_id, count(DISTINCT word)::DOUBLE / count(*) AS d, sum((word IN ('however', 'therefore', 'moreover', 'furthermore', 'additionally', 'meanwhile', 'nevertheless'))::INT)::DOUBLE / count(*) AS r FROM words GROUP BY 1)""",
    lambda spark, sf: structure.detect(_chapters(spark, sf), {"structure": {"vocabulary_diversity_min": 1.1, "connector_ratio_threshold": 0.0}}))

_NAME = "'Image resource: ' || file"
_texts("images", "images", f"""SELECT book_id, severity, code, file, '' AS chapter, 0 AS par, 0 AS sent, {_NAME} AS text, reason FROM (SELECT book_id, file, unnest(list_filter([
  CASE WHEN h <> '' AND copies > 1 THEN {{'code': 'duplicate_image', 'severity': 'low', 'reason': 'Another inventoried image has the same nonempty content hash; review whether both resources are intentionally retained.'}} END,
  CASE WHEN doc_id % 2 <> 0 THEN {{'code': 'unused_image', 'severity': 'medium', 'reason': 'No local HTML image reference was recorded for this image; review whether it is intentionally retained.'}} END,
  CASE WHEN doc_id % 3 < 2 THEN {{'code': 'missing_alt_text', 'severity': 'medium', 'reason': 'No alternative text is available for this image; review accessibility context.'}} END,
  CASE WHEN size <= 0 THEN {{'code': 'missing_size', 'severity': 'medium', 'reason': 'This image has no recorded positive size; review manifest extraction or resource availability.'}} END,
  CASE WHEN h = '' THEN {{'code': 'missing_hash', 'severity': 'low', 'reason': 'This image has no recorded content hash; review resource inventory completeness.'}} END,
  CASE WHEN doc_id % 4 = 0 THEN {{'code': 'generic_filename_weak', 'severity': 'low', 'reason': 'The filename is generic. This is a weak organizational signal only, not evidence of a content problem.'}} END,
  CASE WHEN doc_id % 64 < 32 THEN {{'code': 'small_dimensions', 'severity': 'low', 'reason': 'Locally readable dimensions are ' || (doc_id % 64) || '×100; review whether that size is intentional.'}} END], lambda v: v IS NOT NULL), recursive := true) FROM x)
 UNION ALL SELECT book_id, 'low', 'missing_image_license_context', file, '', 0, 0, {_NAME}, 'No book-level rights or license metadata is available for the inventoried images; review licensing documentation.' FROM (SELECT book_id, arg_min(file, doc_id) AS file FROM r WHERE book_id <> 'src1' GROUP BY 1)""",
    "Review this image resource and its EPUB manifest or HTML references.", """r AS (SELECT source AS book_id, doc_id, 'img/' || CASE WHEN doc_id % 4 = 0 THEN 'img_' ELSE 'figure-' END || doc_id || '.png' AS file, CASE WHEN doc_id % 9 = 0 THEN '' ELSE sha256(text) END AS h, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars END AS size FROM documents),
 x AS (SELECT *, count(*) OVER (PARTITION BY book_id, h) AS copies FROM r)""", lambda spark, sf: images.detect(_images(spark, sf)))  # fmt: skip

_texts("metadata", "metadata", """SELECT book_id, severity, code, file, chapter, 0 AS par, 0 AS sent, text, reason FROM (SELECT doc_id::VARCHAR AS book_id, file, CASE WHEN doc_id % 7 = 0 THEN 'The Book: Part One' ELSE title END AS chapter, unnest(list_filter([
  CASE WHEN doc_id % 7 = 0 THEN {'code': 'title_display_variant', 'severity': 'low', 'text': 'Metadata field “title”: The Book', 'reason': 'Package title “The Book” differs from displayed title “The Book: Part One”; review whether the difference is intentional.'} END,
  CASE WHEN doc_id % 2 <> 0 THEN {'code': 'title_metadata_variant', 'severity': 'medium', 'text': 'Metadata field “title”: The Book', 'reason': 'Title metadata uses multiple title forms; review whether they intentionally describe the same publication.'} END,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN {'code': 'author_metadata_variant', 'severity': 'medium', 'text': 'Metadata field “creator”: A. Writer', 'reason': 'Creator metadata uses multiple author-name forms; review whether they intentionally identify the same contributor.'} END,
  CASE WHEN doc_id % 5 = 0 THEN {'code': 'generator_metadata', 'severity': 'low', 'text': 'Metadata field “generator”: Tool', 'reason': 'Generator metadata (generator: Tool) is present; review whether it is intended for publication.'} END,
  {'code': 'missing_language', 'severity': 'medium', 'text': 'Metadata field “language”: absent or empty.', 'reason': 'Required-looking metadata field “language” is absent or empty; review EPUB package completeness.'},
  {'code': 'missing_identifier', 'severity': 'medium', 'text': 'Metadata field “identifier”: absent or empty.', 'reason': 'Required-looking metadata field “identifier” is absent or empty; review EPUB package completeness.'}], lambda v: v IS NOT NULL), recursive := true) FROM docs)""",
    "Review the EPUB package metadata and align it with the publication’s displayed information.", BASE, lambda spark, sf: metadata.detect(_meta(spark, sf)))

# Repetition at the shipped thresholds, budgets and the findings that say a budget was reached.
_BUDGET = "r * (n - 1) - r * (r - 1) / 2"


def _similar_text(label: str, base: str) -> str:
    return f"""u_{label} AS (SELECT book_id, norm, min(sent_seq) AS s, arg_min(struct_pack(file := file, chapter := chapter, par := par, sent := sent, text := text, w := w), sent_seq) AS f FROM forms_{label} GROUP BY 1, 2),
 r_{label} AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY book_id) AS n FROM u_{label}),
 p_{label} AS (SELECT l.book_id, b.f, list_distinct(l.f.w) AS x, list_distinct(b.f.w) AS y FROM (SELECT * FROM r_{label} WHERE {_BUDGET} < 10000) l JOIN r_{label} b ON l.book_id = b.book_id AND l.r < b.r AND l.r * (l.n - 1) - l.r * (l.r - 1) / 2 + b.r - l.r <= 10000 AND abs(len(l.f.w) - len(b.f.w)) <= greatest(2, len(l.f.w) // 3)),
 d_{label} AS (SELECT *, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS dice FROM p_{label})"""


def _named(label: str, base: str) -> str:
    return base.replace("elig AS", f"elig_{label} AS").replace("forms AS", f"forms_{label} AS").replace("FROM elig)", f"FROM elig_{label})")


_AGAIN = "SELECT book_id, 'medium' AS severity, 'exact_{0}' AS code, file, chapter, par, sent, text, 'Exact repeated {0}; first occurrence is elsewhere in the book.' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY book_id, norm ORDER BY sent_seq) AS nth FROM forms_{0}) WHERE nth > 1"
_ALIKE = "SELECT book_id, 'medium', 'similar_{0}', f.file, f.chapter, f.par, f.sent, f.text, 'Similar {0} wording (' || round_even(dice * 100, 0)::INT || '% shared vocabulary).' FROM d_{0} WHERE dice >= 0.85::DOUBLE"
_texts("repetition", "repetition", f"""{_AGAIN.format('sentence')} UNION ALL {_AGAIN.format('paragraph')} UNION ALL {_ALIKE.format('sentence')} UNION ALL {_ALIKE.format('paragraph')}
 UNION ALL SELECT book_id, 'medium', 'similarity_comparison_cap_reached', f.file, f.chapter, f.par, f.sent, f.text, 'Similarity comparison limit (10000) was reached; similar-wording review may be incomplete.' FROM first_one JOIN (SELECT book_id FROM r_sentence GROUP BY 1 HAVING count(*) * (count(*) - 1) / 2 > 10000 UNION SELECT book_id FROM r_paragraph GROUP BY 1 HAVING count(*) * (count(*) - 1) / 2 > 10000) USING (book_id)
 UNION ALL SELECT book_id, 'medium', 'ngram_occurrence_cap_reached', f.file, f.chapter, f.par, f.sent, f.text, 'N-gram occurrence limit (100000) was reached; repeated-phrase review may be incomplete.' FROM first_one JOIN (SELECT book_id FROM forms_sentence GROUP BY 1 HAVING sum(list_sum(list_transform([3, 4, 5, 6, 7, 8], lambda k: greatest(len(w) - k + 1, 0)))) > 100000) USING (book_id)
 UNION ALL SELECT book_id, 'medium', 'ngram_' || width, last.file, last.chapter, last.par, last.sent, last.text, 'Repeated ' || width || '-token phrase: ' || CASE WHEN contains(phrase, '''') THEN '"' || phrase || '"' ELSE '''' || phrase || '''' END || '.' FROM (SELECT *, row_number() OVER (PARTITION BY book_id, pair ORDER BY width DESC, first) AS nth FROM t) WHERE nth = 1""",
    "Compare the occurrences and retain, vary, or remove intentional repetition.",
    f"""{NEAR_BASE}, {_named('sentence', SENT_ELIGIBLE)}, {_named('paragraph', PAR_ELIGIBLE)}, {_similar_text('sentence', '')}, {_similar_text('paragraph', '')}, first_one AS (SELECT book_id, arg_min(struct_pack(file := file, chapter := chapter, par := par, sent := sent, text := text), sent_seq) AS f FROM forms_sentence GROUP BY 1),
 g AS (SELECT book_id, sent_seq, file, chapter, par, sent, text, k AS width, s, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, unnest([3, 4, 5, 6, 7, 8]) AS k FROM forms_sentence) WHERE len(w) >= k)), o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY sent_seq, width, s) AS o FROM g),
 t AS (SELECT book_id, width, phrase, min(o) AS first, arg_max(struct_pack(file := file, chapter := chapter, par := par, sent := sent, text := text), o) AS last, list_sort(list_slice(list(sent_seq ORDER BY o), 1, 2)) AS pair FROM o WHERE o <= 100000 GROUP BY 1, 2, 3 HAVING count(DISTINCT sent_seq) > 1)""",
    lambda spark, sf: repetition.detect(seeded(spark, sf, seeds=NEAR), load_rules()))
