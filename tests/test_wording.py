"""Repetition without budgets and long phrase lists, against plain Python."""

import itertools
import os
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillscan.functions.phrases import folded, phrases_in
from quillscan.functions.regex import quoted
from quillscan.operators import repeats, repetition
from quillscan.operators.similarity import ordered_sets, similar_pairs
from quillscan.plans.rules import load_rules
from quillscan.tables import from_sentences, from_texts

SF = "/root/testdata/sf0.001"


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


@pytest.mark.parametrize(("crowd", "depth"), [(64, 6), (3, 3), (2, 1)])
@pytest.mark.parametrize("threshold", [0.3, 0.85, 1.0])
def test_similar_pairs(spark, crowd, depth, threshold):
    rng = random.Random(threshold)
    rows = []
    for book in ("a", "b"):
        for n in range(60):
            base = [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(1, 15))]
            for copy in range(3):
                words = [w if rng.random() < 0.9 else "other" for w in base] + ["common"] * rng.randint(0, 2)
                rows.append((book, n * 10 + copy, words))
    sets = ordered_sets(spark.createDataFrame(rows, "book string, key long, w array<string>"), "book", "key", "w")
    got = {(r.book, r.i, r.j): r.dice for r in similar_pairs(sets, threshold, crowd, depth).collect()}
    want = {}
    for (a, i, x), (b, j, y) in itertools.product(rows, rows):
        if a == b and i < j and dice(set(x), set(y)) >= threshold:
            want[a, i, j] = dice(set(x), set(y))
    assert got == want and want


def test_similar_pairs_edges(spark):
    empty = ordered_sets(spark.createDataFrame([], "book string, key long, w array<string>"), "book", "key", "w")
    assert similar_pairs(empty, 0.85).count() == 0
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError, match="similarity_threshold"):
            similar_pairs(empty, bad)
    # one word in all of many texts, and little else: no group meets in one task, no pair is lost
    rows = [("a", n, ["hot", f"x{n % 40}", f"y{n % 7}"]) for n in range(900)]
    sets = ordered_sets(spark.createDataFrame(rows, "book string, key long, w array<string>"), "book", "key", "w")
    assert similar_pairs(sets, 0.9, crowd=8).count() == sum(rows[i][2] == rows[j][2] for i in range(900) for j in range(i))


def test_near_copies_of_a_long_text_make_few_keys(spark, monkeypatch):
    from quillscan.operators import similarity

    made, plain = {}, similarity.settled

    def counted(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "settled", counted)
    rows = [("a", n, [f"w{k}" for k in range(120)] + [f"own{n}"]) for n in range(90)]
    pairs = similar_pairs(ordered_sets(spark.createDataFrame(rows, "book string, key long, w array<string>"), "book", "key", "w"), 0.85)
    assert pairs.count() == 90 * 89 // 2
    # not every choice of two, three, ... of the 32 words of a prefix, of which there are a million
    assert sum(n for name, n in made.items() if name.startswith("similarity-keys")) <= 90 * 100


def test_only_pairs_of_like_sketches_carry_words(spark, monkeypatch):
    from quillscan.operators import similarity

    made, plain = {}, similarity.settled

    def counted(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "settled", counted)
    rng = random.Random(5)
    rows = [("a", n, rng.sample([f"w{k}" for k in range(300)], 40)) for n in range(200)]
    rows += [("a", 1000 + n, [*w[1:], "new"]) for _, n, w in rows[:30]]
    pairs = similar_pairs(ordered_sets(spark.createDataFrame(rows, "book string, key long, w array<string>"), "book", "key", "w"), 0.85)
    assert {(r.i, r.j) for r in pairs.collect()} >= {(n, 1000 + n) for n in range(30)}
    # of thousands that share a rare word
    assert made["similarity-pairs"] <= 60


@pytest.mark.parametrize(("together", "family"), [(20_000, 1_000_000), (7, 5), (1, 1)])
def test_pairs_are_compared_wherever_they_are_dealt(spark, together, family):
    from quillscan.operators import similarity

    rng = random.Random(together)
    rows = [(b, n, [f"w{k}" for k in range(12) if rng.random() < 0.8] or ["one"]) for b in "ab" for n in range(30)]
    sets = ordered_sets(spark.createDataFrame(rows, "book string, key long, w array<string>"), "book", "key", "w").localCheckpoint()
    sids = {(r.book, r.key): r.sid for r in sets.select("book", "key", "sid").collect()}
    # every pair, also of different books, which are never similar
    pairs = spark.createDataFrame([(min(x, y), max(x, y)) for x, y in itertools.combinations(sids.values(), 2)], "x long, y long")
    got = sorted((r.book, r.i, r.j, r.dice) for r in similarity._compared(pairs, sets, 0.8, together, family).collect())
    assert got == sorted((a, i, j, dice(set(x), set(y))) for (a, i, x), (b, j, y) in itertools.combinations(rows, 2) if a == b and dice(set(x), set(y)) >= 0.8) and got


def brute(sentences, low):
    found = {}
    for (book, at, w) in sentences:
        for i in range(len(w)):
            for j in range(i + low, len(w) + 1):
                found.setdefault((book, tuple(w[i:j])), []).append((at, i, w[i - 1] if i else None, w[j] if j < len(w) else None))
    out = set()
    for (book, phrase), at in found.items():
        diverse = lambda k: any(x[k] is None for x in at) or len({x[k] for x in at}) > 1
        if len(at) > 1 and diverse(2) and diverse(3):
            out.add((book, len(phrase), len(at), min(at)[:2], max(at)[:2], " ".join(phrase)))
    return out


@pytest.mark.parametrize("low", [1, 3])
def test_maximal_repeats(spark, low):
    rng = random.Random(low)
    sentences = [(b, n, [rng.choice("abc") for _ in range(rng.randint(1, 14))]) for b in ("p", "q") for n in range(25)]
    sentences += [("p", 100, list("xyxyxyxyxyxyxyxyx")), ("p", 101, ["same"] * 70), ("q", 102, list("the whole line")), ("q", 103, list("the whole line")), ("r", 104, ["alone"])]
    rows = spark.createDataFrame(sentences, "book_id string, ord long, w array<string>")
    got = {(r.book_id, r.width, r.n, (r.first.ord, r.first.pos), (r.last.ord, r.last.pos), r.phrase) for r in repeats.maximal_repeats(rows, low).collect()}
    assert got == brute(sentences, low)
    assert repeats.maximal_repeats(rows.limit(0), low).count() == 0
    with pytest.raises(ValueError, match="width"):
        repeats.maximal_repeats(rows, 0)


@pytest.mark.parametrize(("low", "span", "reach"), [(1, 2, 2), (1, 3, 5), (3, 4, 7), (2, 16, 20)])
def test_maximal_repeats_by_each_step(spark, low, span, reach):
    """The same phrases, whichever step finds them: together with their first tokens, in stretches, or by bisection."""
    rng = random.Random(span)
    text = [rng.choice("abcdefgh") for _ in range(60)]
    sentences = [("p", n, [w if rng.random() < 0.95 else "z" for w in text]) for n in range(4)] + [("p", 10, list("xy" * 22)), ("p", 11, list("xy" * 15 + "q")), ("p", 12, ["same"] * 33), ("q", 13, ["same"] * 41), ("p", 14, ["same"] * 20 + ["end"])]
    sentences += [("q", 20 + n, [rng.choice("ab") for _ in range(rng.randint(1, 40))]) for n in range(8)]
    rows = spark.createDataFrame(sentences, "book_id string, ord long, w array<string>")
    found = repeats.maximal_repeats(rows, low, span, reach).collect()
    got = {(r.book_id, r.width, r.n, (r.first.ord, r.first.pos), (r.last.ord, r.last.pos), r.phrase) for r in found}
    assert got == brute(sentences, low) and len(got) == len(found)


def test_repeats_of_usual_length_need_no_levels(spark, monkeypatch):
    made, plain = {}, repeats.settled

    def counted(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "settled", counted)
    rows = [("a", n, [f"w{n % 3}", "the", "same", "few", "words", f"in{n}"]) for n in range(40)] + [("a", 40 + n, ["again"] * 300) for n in range(2)]
    assert repeats.maximal_repeats(spark.createDataFrame(rows, "book_id string, ord long, w array<string>")).where("phrase = 'the same few words'").first().n == 40
    # neither a level for each binary digit of the longest line, nor rows beyond the places that may begin a phrase
    assert not [name for name in made if "level" in name] and max(made.values()) < 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_maximal_repeats_of_documents(spark):
    import duckdb

    from quillscan.plans import wording_queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(wording_queries.REPEATS)
    got = wording_queries.QUERIES["maximal_repeats"](spark, SF).select(*[d[0] for d in want.description])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_detect_without_budgets(spark):
    line = "the quick brown fox jumps over the lazy dog near the river"
    t = from_sentences(spark, [("a", "A", [line, line.replace("quick", "fast"), "nothing here is like the other lines of this page", line])])
    rules = {"repetition": {"max_sentence_pairs": None, "max_ngram_occurrences": None, "similarity_threshold": 0.8}}
    found = {(r.code, r.paragraph, r.reason) for r in repetition.detect(t, rules).collect()}
    assert {c for c, _, _ in found} == {"exact_sentence", "exact_paragraph", "similar_sentence", "similar_paragraph", "ngram_12"}
    assert ("ngram_12", 3, f"Repeated 12-token phrase: '{line}'.") in found and ("similar_sentence", 1, "Similar sentence wording (90% shared vocabulary).") in found
    with pytest.raises(ValueError):
        repetition.detect(t, {"repetition": {"max_sentence_pairs": -1}})
    assert load_rules() is not None


def test_case_is_ignored_as_by_the_jvm(spark):
    fold = folded()
    codes = [c for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c))[0] == "L" or fold[c] != c)]
    rows = spark.createDataFrame([(c, chr(c), chr(int(fold[c])), f"(?iu)\\x{{{int(fold[c]):x}}}") for c in codes], "c int, char string, other string, p string")
    known = ~F.col("char").rlike(r"\p{Cn}|\x{1e9e}") & ~F.col("other").rlike(r"\p{Cn}")
    assert rows.where(known).count() > 20_000
    assert not rows.where(known & ~F.expr("char rlike p")).select("c").collect()
    # and what is not alike for the one is not for the other: letters whose forms differ never match each other's neighbour
    pairs = [(chr(a), chr(b), bool(fold[a] == fold[b])) for a, b in zip(codes, codes[1:])]
    told = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert told.where(~F.concat("a", "b").rlike(r"\p{Cn}|\x{1e9e}") & (F.expr("a rlike concat('(?iu)', b)") != F.col("same"))).count() == 0


def test_phrase_lists(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abAB é.ßİ한") for _ in range(rng.randint(1, 4)))
    texts = ["".join(word() for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "ab " * 3000, "x" * 700 + "needle in hay" + "y" * 600, "NEEDLE IN HAY"]
    phrases = list(dict.fromkeys(word() for _ in range(300))) + ["needle in hay", "x" * 600, "", "never found at all", "needle"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    patterns = [re.compile(re.escape(p), re.IGNORECASE) for p in phrases]  # only to know which are there at all
    assert any(p.search("NEEDLE IN HAY") for p in patterns)
    chain = F.filter(F.array(*[F.when(F.col("text").rlike(quoted(p)), F.lit(n)) for n, p in enumerate(phrases) if p]), lambda x: x.isNotNull())
    fold = folded()
    form = lambda p: tuple(int(fold[ord(c)]) for c in p)
    first = {}
    for n, p in enumerate(phrases):
        first.setdefault(form(p), n)
    want = {r.i: sorted({first[form(phrases[n])] for n in r.c or []}) for r in rows.select("i", chain.alias("c")).collect()}
    for most in (64 << 20, 4000):
        got = {r.i: r.p for r in rows.select("i", phrases_in(spark, F.col("text"), phrases, most).alias("p")).collect()}
        assert got == want
    assert rows.select(phrases_in(spark, F.col("text"), [""]).alias("p")).where(F.size("p") > 0).count() == 0


def test_large_batches_are_looked_through_in_parts():
    """A batch of many texts takes no more memory than a part of it, and finds the same."""
    import tracemalloc

    from quillscan.functions.phrases import AT_ONCE, _finder, automata, code_points, stretches

    machine = automata(["needle", "hay"])[0]
    texts = pa.array(["x" * 9_000 + ("NEEDLE" if n % 7 == 0 else "") + ("hay" if n % 3 == 0 else "") for n in range(3_000)] + [None, "", "hay" * 3])
    parts = stretches(texts)
    assert len(parts) > 5 and [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(texts)
    assert stretches(pa.array(["y" * (AT_ONCE + 1), "z"])) == [(0, 1), (1, 2)] and stretches(pa.array([], pa.string())) == []
    shared = type("Shared", (), {"value": machine})
    tracemalloc.start()
    got = _finder(shared)(texts).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [[] for _ in range(len(texts))]
    for row, phrase in zip(*machine.hits(*code_points(texts))):
        want[row].append(phrase)
    assert got == want and most < 40 * AT_ONCE
    assert _finder(shared)(texts.slice(2_995)).to_pylist() == want[2_995:]


def test_ten_thousand_phrases(spark):
    from quillscan.operators import residue

    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrases = ["".join(rng.choice(letters) for _ in range(4)) + f" {n}" for n in range(10_000)]
    texts = [("b", n, "f", "t", f"Start {rng.choice(phrases).upper() if n % 3 else 'none'} end") for n in range(300)]
    t = from_texts(spark.createDataFrame(texts, "book_id string, chapter_seq long, file string, title string, text string"))
    found = {r.excerpt for r in residue.detect(t, {"chatbot_residue": {"patterns": [], "phrases": phrases}}).collect()}
    assert found == {x[4] for x in texts if any(p in x[4].lower() for p in phrases)} and len(found) > 150


@pytest.mark.parametrize("most", [1, 4, 7, 100])
def test_first_forms_of_a_book_are_pruned_by_chapter(spark, most):
    lines = [[f"line {c} {n % 4} of this little chapter" for n in range(5)] + ["a line that all the chapters share"] for c in range(5)]
    rows = repetition.eligible(from_sentences(spark, [(f"{c}", f"{c}", x) for c, x in enumerate(lines)]), 5)[0]
    seen = list(dict.fromkeys(line for x in lines for line in x))
    forms, counts = repetition.unique_forms(rows, most)
    assert [r.text for r in sorted(forms.collect(), key=lambda r: r.r)] == seen[:most] and counts.first().n == len(seen)
    # chapters that lie wholly beyond the bound are not sorted
    chapters = repetition._before(rows.dropDuplicates(["norm"]), F.lit(1))
    left = {r.ord.chapter_seq for r in repetition._within(rows, chapters, 4).collect()}
    assert left == {0}


def test_only_runs_that_occur_again_get_rows(spark):
    """The first count is packed: rows are made of what is repeated, however it is dealt, and hashes of tokens are not kept."""
    rng = random.Random(5)
    sentences = [("b", n, [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]) for n in range(200)] + [("b", 200, [f"w{n}" for n in range(5_000)]), ("c", 201, list("abcdefgh"))]
    rows = spark.createDataFrame(sentences, "book_id string, ord long, w array<string>").repartition(5)
    numbered = repeats.numbered_sentences(rows, 3)
    places = {r.sid: (r.book, r.ord) for r in numbered.collect()}
    seen = {}
    for book, at, w in sentences:
        for i in range(len(w) - 2):
            seen.setdefault((book, *w[i : i + 3]), set()).add((book, at, i))
    want = {x for xs in seen.values() if len(xs) > 1 for x in xs}
    for most in (repeats.BUCKET, 700):
        assert {(*places[r.sid], r.pos) for r in repeats._again(numbered, 3, most).collect()} == want
    assert 100 < len(want) < 2_000


def test_repetition_cuts_its_text_once(spark):
    t = from_sentences(spark, [("a", "A", ["one line of five words here", "one line of five words here", "another line of other words there"])])
    found = repetition.detect(t, load_rules())
    # every part reads the words that were kept, and none cuts them out of the text again
    assert "regexp_extract_all" in repetition.eligible(t, 5)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("code = 'exact_sentence'").count() == 1
