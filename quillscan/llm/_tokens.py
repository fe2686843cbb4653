"""Byte-level BPE ids through the tokenizers library, with whole words remembered.

The vocabulary's splitter never lets a token span a single space or line end between two other
characters, so a text is the concatenation of its words, each with the space or line end before it,
and each distinct word needs encoding only once. Texts where that does not hold (runs of white space, white space at an
end, very long words, or the content of an added token such as <|endoftext|>, which the library codes as that token) are
encoded whole.

Words are remembered in arrays of fixed size (``SLOTS``; about 50 MB a worker whatever the texts), found by 64-bit hashes:
with 2**20 words at hand a new word is taken for another with a chance of 6e-14. When the table is half full, the words
that were met again since they came stay and the others go.
"""

from __future__ import annotations

import os
import re

import numpy as np

from quillscan.llm._bytes import mix, prefix, span

END_ID = 2
_TAIL = re.compile(r"(\n?[^\W\d_]+)([^\w\s']+)")
#: Places for words (half of them are used), ids and bytes of a word that is remembered, words coded in one call of the library.
SLOTS, MOST_IDS, MOST_BYTES, TOGETHER = 1 << 21, 200, 512, 50
_LINE = np.uint64(0x2545F4914F6CDD1D)


class Encoder:
    """``encode(raw, offsets, end)`` gives the ids of some texts, each followed by ``end``, and their counts."""

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        mark = lambda c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c + "a")[0][0][0]
        self.opens, self.breaks = (np.array([t.startswith(mark(c)) for t in tokens]) for c in " \n")
        self.marks: dict[str, bytes] = {}
        self.slots, self.mask = slots, np.uint64(slots - 1)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)  # 0: free
        self.start, self.size = np.zeros(self.slots, np.uint32), np.zeros(self.slots, np.uint8)  # no ids: not to be coded by itself
        self.met = np.zeros(self.slots, bool)
        self.ids, self.used, self.words = np.zeros(1 << 16, "<u4"), 0, 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of words, a line's first one with its line end; none where a word cannot be coded by itself."""
        known, tails, spaced, lines = {}, [], [], []
        for word in new:
            if word.isalpha():
                spaced.append(word)
            elif cut := _TAIL.fullmatch(word):  # marks after letters are split off by themselves
                tails.append((word, *cut.groups()))
            else:
                own = word[1:] if word[:1] == "\n" else word
                if own and not own[0].isspace() and not own[-1].isspace():
                    (spaced if own is word else lines).append(word)
        bare = {w for _, w, _ in tails}.difference(spaced, lines)
        known.update(self._coded(spaced + [w for w in bare if w[0] != "\n"], " ", self.opens))
        known.update(self._coded(lines + [w for w in bare if w[0] == "\n"], "", self.breaks))
        if len(self.marks) > 20_000:
            self.marks.clear()
        for marks in {m for _, _, m in tails}.difference(self.marks):
            self.marks[marks] = self.whole(marks)
        known.update([(w, known[a] + self.marks[b]) for w, a, b in tails])
        return [known.get(w, b"") for w in new]

    def _coded(self, words: list[str], lead: str, opens: np.ndarray):
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for i in range(0, len(groups), 100):
            some = groups[i : i + 100]
            for part, coded in zip(some, self.tokenizer.encode_batch_fast([lead + lead.join(p) for p in some], add_special_tokens=False)):
                ids = np.array(coded.ids, "<u4")
                at = np.flatnonzero(opens[ids])
                if len(at) != len(part):
                    yield from ((word, self.whole(lead + word)) for word in part)
                    continue
                data, ends = ids.tobytes(), (4 * np.append(at[1:], len(ids))).tolist()
                yield from zip(part, [data[a:b] for a, b in zip((4 * at).tolist(), ends)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where one is not there."""
        out = np.full(len(keys), -1, np.int64)
        live, slot = np.arange(len(keys)), keys & self.mask
        while len(live):
            there = self.keys[slot]
            hit = there == keys[live]
            out[live[hit]] = slot[hit]
            on = ~hit & (there != 0)
            live, slot = live[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _put(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.words = self.used + len(ids), self.words + len(keys)
        live, slot = np.arange(len(keys)), keys & self.mask
        while len(live):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[live[free]]  # of several for one place one gets it
            won = free & (self.keys[slot] == keys[live])
            at, k = slot[won], live[won]
            self.start[at], self.size[at] = starts[k], sizes[k]
            live, slot = live[~won], (slot[~won] + np.uint64(1)) & self.mask

    def _make_room(self) -> None:
        """Keep the words that were met again; none where that is too many, or their ids take too much."""
        stay = np.flatnonzero(self.met)
        if 4 * len(stay) > self.slots or self.size[stay].sum(dtype=np.int64) > 4 * self.slots:
            stay = stay[:0]
        keys, sizes = self.keys[stay], self.size[stay].astype(np.int64)
        ids = self.ids[_spread(self.start[stay].astype(np.int64), sizes)]
        self._clear()
        self._put(keys, ids, sizes)

    def _ids(self, data: bytes, key: np.ndarray, starts: np.ndarray, stop: np.ndarray, line: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, and how many each has; a text's first word is coded as if after a line end, whose id is left out."""
        slot = self._find(key)
        new = np.flatnonzero(slot < 0)
        if len(new) and 2 * (self.words + len(new)) > self.slots:
            self._make_room()
            slot = self._find(key)
            new = np.flatnonzero(slot < 0)
        self.met[slot[slot >= 0]] = True
        if len(new):
            fresh, some = np.unique(key[new], return_index=True)
            at = new[some]
            coded = self._learn([("\n" if nl else "") + data[a:b].decode("utf-8") for a, b, nl in zip(starts[at].tolist(), stop[at].tolist(), line[at].tolist())])
            coded = [c if len(c) <= 4 * MOST_IDS else b"" for c in coded]
            self._put(fresh, np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded]))
            slot[new] = self._find(key[new])
        at, sizes = self.start[slot].astype(np.int64), self.size[slot].astype(np.int64)
        cut = first & (sizes > 0)
        return self.ids[_spread(at + cut, sizes - cut)], np.where(sizes > 0, sizes - cut, -1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        rows, data = len(offsets) - 1, raw.tobytes()
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return np.full(rows, end, "<u4"), np.ones(rows, np.int64)
        gap = np.flatnonzero((raw == 32) | (raw == 10))
        first = np.zeros(len(gap) + len(filled), bool)
        first[np.searchsorted(gap, offsets[filled]) + np.arange(len(filled))] = True
        starts, line, row = np.empty(len(first), np.int64), first.copy(), filled[np.cumsum(first) - 1]
        starts[first], starts[~first], line[~first] = offsets[filled], gap + 1, raw[gap] == 10
        stop = offsets[row + 1]
        stop[:-1] = np.where(first[1:], stop[:-1], starts[1:] - 1)
        bad = np.zeros(rows, bool)
        bad[row[(stop <= starts) | (stop - starts > MOST_BYTES)]] = True
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                bad[np.searchsorted(offsets, at, "right") - 1] = True
                at = data.find(token, at + 1)
        use = ~bad[row]
        starts, stop, row, line, first = (x[use] for x in (starts, stop, row, line, first))
        key = span(prefix(raw), starts, stop)
        key[line] = mix(key[line] ^ _LINE)
        key[key == 0] = 1
        ids, sizes, step = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], self.slots // 8
        for a in range(0, len(key), step):
            some = slice(a, a + step)
            got = self._ids(data, key[some], starts[some], stop[some], line[some], first[some])
            ids.append(got[0])
            sizes.append(got[1])
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        bad[row[sizes < 0]] = True
        sizes = np.maximum(sizes, 0)
        if bad.any():
            ids, sizes = ids[~np.repeat(bad[row], sizes)], np.where(bad[row], 0, sizes)
        counts = np.bincount(row, weights=sizes, minlength=rows).astype(np.int64)
        if bad.any():
            ends, parts, done = np.cumsum(counts), [], 0
            for r in np.flatnonzero(bad).tolist():
                own = np.frombuffer(self.whole(data[offsets[r] : offsets[r + 1]].decode("utf-8")), "<u4")
                parts += [ids[done : ends[r]], own]
                done, counts[r] = ends[r], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        out = np.full(len(ids) + rows, end, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(rows), counts)] = ids
        return out, counts + 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 .. for each run of so many."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
