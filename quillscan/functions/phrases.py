"""Lists of thousands of phrases, found in one pass: an Aho-Corasick automaton in flat arrays.

Case is ignored as the JVM's ``(?iu)`` does for literals: two characters agree if lower case of upper case does. (Pairs that
are younger than the JVM's tables, and capital sharp s, which it matches one way only, agree here.) The
transition table is dense over the characters that phrases use, so that a step is one lookup; all texts of a batch step
together, long ones cut into overlapping pieces. A list whose table would exceed ``MOST_BYTES`` is cut into
several automata, each of which is broadcast and run for itself.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of one automaton's table, and characters of a piece of text.
MOST_BYTES, PIECE = 64 << 20, 512
#: Bytes of texts that are looked through at once: a batch of thousands of long texts would take some thirty times its size.
AT_ONCE = 4 << 20


@cache
def folded() -> np.ndarray:
    """The caseless form of every code point."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(0x20000):
        char = chr(code)
        upper = char.upper()
        if len(upper) > 1:
            upper = char.title() if len(char.title()) == 1 else char
        table[code] = ord(upper.lower()[0])
    return table


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column in one array, and the offsets of its rows; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), starts[offsets - offsets[0]]


def stretches(texts: pa.Array, most: int = AT_ONCE) -> list[tuple[int, int]]:
    """Consecutive rows of a string column in parts of at most ``most`` bytes, or of one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        out.append((a, b))
        a = b
    return out


@dataclass
class Automaton:
    """States by breadth: ``step[state, class]``, the phrase that ends in a state (or -1), and the next shorter state in which one ends (or 0)."""

    classes: np.ndarray
    step: np.ndarray
    phrase: np.ndarray
    shorter: np.ndarray
    longest: int

    @classmethod
    def of(cls, phrases: Sequence[tuple[int, str]]) -> Automaton:
        fold = folded()
        codes = [fold[np.frombuffer(p.encode("utf-32-le"), "<u4")].tolist() for _, p in phrases]
        used = {c: i for i, c in enumerate(sorted({c for p in codes for c in p}), 1)}
        children: list[dict[int, int]] = [{}]
        ends = {}
        for (number, _), word in zip(phrases, codes):
            state = 0
            for c in word:
                state = children[state].setdefault(used[c], len(children))
                if state == len(children):
                    children.append({})
            ends[state] = min(number, ends.get(state, number))
        step = np.zeros((len(children), len(used) + 1), np.int32)
        phrase, shorter, fail = np.full(len(children), -1, np.int32), np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        for state, number in ends.items():
            phrase[state] = number
        queue = [0]
        for state in queue:
            back = int(fail[state])
            if state:
                step[state] = step[back]
                shorter[state] = back if phrase[back] >= 0 else shorter[back]
            for c, child in children[state].items():
                fail[child] = step[state, c] if state else 0
                step[state, c] = child
                queue.append(child)
        lookup = np.zeros(sys.maxunicode + 1, np.uint16 if len(used) < 65_535 else np.uint32)
        for c, i in used.items():
            lookup[c] = i
        return cls(lookup[fold], step, phrase, shorter, max(map(len, codes)))

    def hits(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and phrase of everything found, each pair once, in order."""
        size = np.diff(offsets)
        count = np.maximum(1, -(-size // PIECE))
        row = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[row] + nth * PIECE
        # a phrase that ends in a piece may begin before it
        start, end = np.maximum(start - self.longest + 1, offsets[row]), np.minimum(start + PIECE, offsets[row + 1])
        order = np.argsort(start - end, kind="stable")
        row, start, left = row[order], start[order], (end - start)[order]
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), "left")
        told = (self.phrase >= 0) | (self.shorter > 0)
        state, found = np.zeros(len(row), np.int32), []
        for k, n in enumerate(active.tolist()):
            state[:n] = self.step[state[:n], self.classes[codes[start[:n] + k]]]
            at = np.flatnonzero(told[state[:n]])
            s = state[at]
            while len(at):
                own = self.phrase[s] >= 0
                found.append(np.column_stack([row[at[own]], self.phrase[s[own]]]))
                s = self.shorter[s]
                at, s = at[s > 0], s[s > 0]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def automata(phrases: Sequence[str], most_bytes: int = MOST_BYTES) -> list[Automaton]:
    """Automata of a list, each within the bound (or of one phrase); empty phrases, and those that differ from an earlier one in case alone, are in none."""
    out, block, states, used, seen, fold = [], [], 1, set(), {b""}, folded()
    for number, phrase in enumerate(phrases):
        form = fold[np.frombuffer(phrase.encode("utf-32-le"), "<u4")].tobytes()
        if form in seen:
            continue
        seen.add(form)
        wider = used | set(phrase)
        if block and (states + len(phrase)) * (len(wider) + 1) * 4 > most_bytes:
            out.append(Automaton.of(block))
            block, states, wider = [], 1, set(phrase)
        block.append((number, phrase))
        states, used = states + len(phrase), wider
    return out + ([Automaton.of(block)] if block else [])


def _finder(shared):
    def run(texts: pa.Array) -> pa.Array:
        rows, phrases = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in stretches(texts):
            row, phrase = shared.value.hits(*code_points(texts.slice(a, b - a)))
            rows.append(row + a)
            phrases.append(phrase)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(np.concatenate(rows), np.arange(len(texts) + 1)), pa.int32()), pa.array(np.concatenate(phrases), pa.int32()))

    return run


def phrases_in(spark: SparkSession, text: Column, phrases: Sequence[str], most_bytes: int = MOST_BYTES) -> Column:
    """Numbers, ascending, of the phrases that a text holds, whatever their case; of phrases that differ in case alone the first's.

    Null and empty texts hold none, empty phrases are held by none.
    """
    parts = [F.arrow_udf(_finder(spark.sparkContext.broadcast(machine)), "array<int>")(text) for machine in automata(phrases, most_bytes)]
    none = F.array().cast("array<int>")
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0] if parts else none
