import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscan.llm import packing, token_blocks
from quillscan.llm._bytes import flat
from quillscan.llm._tokens import Encoder, vocabulary

END = np.array([2], "<u4").tobytes()


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary())


def plain(text):
    from tokenizers import Tokenizer

    if not hasattr(plain, "library"):
        plain.library = Tokenizer.from_file(vocabulary())
    return plain.library.encode(text, add_special_tokens=False).ids


def coded(encoder, texts):
    ids, counts = encoder.encode(*flat(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


#: Few places, so that words are forgotten and come back.
SMALL = Encoder(vocabulary(), 256)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,'\n\t\u00a0é漢<|>endoftxt1"), max_size=60), max_size=5))
def test_remembered_words_are_coded_like_the_library_codes_texts(texts):
    assert coded(SMALL, texts) == [plain(t) + [2] for t in texts] or not texts


@pytest.mark.parametrize("at", range(6))
def test_added_tokens_are_coded_like_the_library_codes_them(encoder, at):
    words = "some words and more words".split(" ")
    inside = " ".join([*words[:at], "<|endoftext|>", *words[at:]])
    texts = [inside, inside.replace(" ", ""), "plain words", f" {inside}\n", inside + inside, "<|endoftext| >", "", None]
    assert coded(encoder, texts) == [plain(t or "") + [2] for t in texts]


def test_very_many_and_very_long_words():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 2000)) for _ in range(4)] + ["x" * 100_000 + " y", "\n".join("ab cd" for _ in range(500))]
    assert coded(SMALL, texts) == [plain(t) + [2] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    docs, lengths, got = token_blocks.unpack(token_blocks.pack([None, 5], [0, len(ids)], ids, percentile=percentile))
    assert docs == [None, 5] and lengths.tolist() == [0, len(ids)] and got.tolist() == ids.tolist()


def test_written_tokens(odd, none, encoder):
    got = sorted(token_blocks.read_tokens(token_blocks.write_tokens(odd, segment_tokens=500)).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    start = 0
    for r, (known, doc, text) in zip(got, want, strict=True):
        ids = encoder.whole(text) + END
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc if known else None, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_blocks.read_tokens(token_blocks.write_tokens(none)).count() == 0


def check_pieces(rows, texts, encoder, capacity):
    bins = {}
    total = 0
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert total == sum(len(encoder.whole(t)) // 4 + 1 for t in texts)
    return len(bins), -(-total // capacity)


def test_packing(odd, none, encoder):
    texts = [r.text or "" for r in odd.collect()]
    got = packing.pack(odd).collect()
    used, floor = check_pieces(got, texts, encoder, 1024)
    assert used <= floor + 1
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple(plain(r.text or "") + [2])) for r in odd.collect())
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    whole = {}
    for known, doc, ids in want:
        n, cut = len(ids), [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        raw = np.array(ids, "<u4").tobytes()
        whole.setdefault(doc if known else None, []).extend((x, y - x, zlib.crc32(raw[4 * x : 4 * y])) for x, y in zip(cut, cut[1:]))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in whole.items()}
    long = sorted((r for r in got if r.doc_id == 10), key=lambda r: r.piece)
    assert len(long) > 2 and all(r.length == 1024 for r in long[1:]) and long[0].length <= 1024
    ids = encoder.whole("word " * 40_000) + END
    assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in long)
    assert packing.pack(none).count() == 0


def test_packing_small_chunks_and_many_islands(odd, encoder):
    texts = [r.text or "" for r in odd.collect()]
    check_pieces(packing.pack(odd, chunk=4, islands=3, epochs=3).collect(), texts, encoder, 1024)


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 200)
    parents = packing.evolve(sizes, 100, [], rng, population=4, generations=0)
    people = packing.evolve(sizes, 100, parents, rng, population=4, generations=8)
    best = people[0]
    assert len(best) == 200 and np.bincount(best, weights=sizes).max() <= 100
    assert packing.bins(best) <= packing.bins(parents[0])
