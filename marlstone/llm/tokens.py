"""Token counts by a compiled finite-state transducer.

The vocabulary is a byte-pair encoding with word ends.  For a prefix of a word,
the tokens of the prefix are fixed by its last token, since a sequence of tokens
is the encoding of its string exactly if each token and each adjacent pair
encodes to itself.  Reading a symbol (a byte, marked if it ends its word), the
machine keeps, for every position where a token may still begin, the trie node
reached since, the last token before it, and its token count less the current
one.  That is a finite state; a transition is annotated with the change of the
count.  States are made when first met, in a hash table read in bulk.

A batch of texts is one sequence of symbols, cut into chunks that run in lock
step.  A chunk with a word end has a constant state map beyond a head.  A chunk
without one is mapped on the states that occur: all such chunks run in lock step
from the exits known so far, which a scan composes, until the scan meets no
state that a map lacks.  Machines that read the same symbols soon agree, so that
takes a few rounds, also inside a word of a million letters.  The scan gives
every chunk its entry state, after which all heads run.

Words, special strings and normalisation follow the library for this file:
special strings count one token each, then NFC, white space dropped, lower case
by character, contractions, runs of letters, single numbers, runs of the rest.

Null text counts as empty (0 tokens).  Texts of any length are read whole.
Repeated rows get equal counts; an empty table gives none.  Other columns pass
through, but for the three that this operator adds, which are replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_TOKENS = 2048
#: Characters handled at once, and symbols in a chunk.
SLICE, CHUNK = 1 << 20, 512
#: Transitions held before the table is started afresh.
MAX_TRANSITIONS = 4_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The contractions of the pattern, and Unicode white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_NONE = -1


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """State 0 is the start of a word.  Symbols: byte, or 256 + byte at a word's end."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        end, letters = model["end_of_word_suffix"], _byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            closed = token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if closed else token)]
            return (*body[:-1], body[-1] + 256 * closed)

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.pieces = {i: s for s, i in ids.items()}
        self.single = {s[0]: i for s, i in ids.items() if len(s) == 1}
        self.merge = {}
        for rank, (a, b) in enumerate(merges):
            x, y = symbols(a), symbols(b)
            self.merge[ids[x], ids[y]] = (rank, ids[x + y])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [_NONE]
        for s, i in sorted(ids.items()):
            if self.encode(s) == [i]:
                node = 0
                for x in s:
                    if x not in self.children[node]:
                        self.children[node][x] = len(self.children)
                        self.children.append({})
                        self.token_at.append(_NONE)
                    node = self.children[node][x]
                self.token_at[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """Plain merging by rank; used to compile, not to count."""
        out = [self.single[x] for x in symbols]
        while len(out) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merge), default=None)
            if best is None:
                return out
            k = best[1]
            out[k : k + 2] = [self.merge[out[k], out[k + 1]][1]]
        return out

    def fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.encode(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def clear(self) -> None:
        self.states = [((0, _NONE, 0),)]
        self.number = {self.states[0]: 0}
        self.keys = np.full(1 << 12, -1, np.int64)
        self.next = np.zeros(1 << 12, np.int32)
        self.gain = np.zeros(1 << 12, np.int8)
        self.held = 0

    def follow(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count), computed from the definition."""
        moved, found = [], None
        for node, last, ahead in self.states[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if token != _NONE and found is None and (last == _NONE or self.fit(last, token)):
                found = (token, ahead + 1)
            if self.children[child]:
                moved.append((child, last, ahead))
        token, gain = found
        if symbol >= 256:
            return 0, gain
        made = tuple(sorted({(child, last, ahead - gain) for child, last, ahead in moved} | {(0, token, 0)}))
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
        return self.number[made], gain

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(len(self.keys)).bit_length() + 1)).astype(np.int64)

    def _add(self, key: int, state: int, gain: int) -> None:
        at, mask = int(self._slot(np.array([key]))[0]), len(self.keys) - 1
        while self.keys[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.next[at], self.gain[at] = key, state, gain
        self.held += 1

    def _grow(self) -> None:
        old = self.keys >= 0
        keys, nexts, gains = self.keys[old], self.next[old], self.gain[old]
        size = 4 * len(self.keys)
        self.keys, self.next, self.gain = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int8)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # one of several wins
            won = self.keys[at[left]] == keys[left]
            self.next[at[left[won]]], self.gain[at[left[won]]] = nexts[left[won]], gains[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (size - 1)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of many machines at once."""
        keys = (states.astype(np.int64) << 9) | symbols
        at = self._slot(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            empty = off[self.keys[at[off]] < 0]
            if len(empty):
                for key in np.unique(keys[empty]):
                    self._add(int(key), *self.follow(int(key) >> 9, int(key) & 511))
                if 2 * self.held > len(self.keys):
                    self._grow()
                at = self._slot(keys)
                off = np.arange(len(keys))
            else:
                at[off] = (at[off] + 1) & (len(self.keys) - 1)
            off = off[self.keys[at[off]] != keys[off]]
        return self.next[at], self.gain[at]

    def gains(self, symbols: np.ndarray) -> np.ndarray:
        """The change of the count at every symbol of one long sequence."""
        if self.held > MAX_TRANSITIONS:
            self.clear()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int8)
        rows = -(-n // CHUNK)
        grid = np.zeros((rows, CHUNK), np.int64)
        grid.reshape(-1)[:n] = symbols
        grid.reshape(-1)[n:] = -1
        out = np.zeros((rows, CHUNK), np.int8)
        ends = grid >= 256
        constant = ends.any(axis=1)
        head = np.where(constant, ends.argmax(axis=1) + 1, CHUNK)
        # a chunk's map beyond its head, from the start state
        state = np.zeros(rows, np.int32)
        columns = np.ascontiguousarray(grid.T)
        for k in range(CHUNK):
            live = np.flatnonzero((k >= head) & (columns[k] >= 0))
            if len(live):
                state[live], out[live, k] = self.step(state[live], columns[k][live])
        # scan: entry[i] is the exit of chunk i - 1
        maps: list[dict[int, int]] = [{} for _ in range(rows)]
        open_ = np.flatnonzero(~constant).tolist()
        entry = np.zeros(rows, np.int32)
        while True:
            lacking = []
            for i in open_:
                entry[i] = state[i - 1] if i else 0
                held = maps[i].get(int(entry[i]))
                if held is None:
                    lacking.append(i)  # until it has run, its last exit is the guess
                else:
                    state[i] = held
            if not lacking:
                break
            some = np.array(lacking)
            run = entry[some].copy()
            for k in range(CHUNK):
                live = np.flatnonzero(columns[k][some] >= 0)
                if len(live):
                    run[live] = self.step(run[live], columns[k][some[live]])[0]
            for i, at in zip(lacking, run, strict=True):
                maps[i][int(entry[i])] = int(at)
                state[i] = at
        entry[1:] = state[:-1]
        entry[0] = 0
        for k in range(int(head.max(initial=0))):
            live = np.flatnonzero((k < head) & (columns[k] >= 0))
            if len(live):
                entry[live], out[live, k] = self.step(entry[live], columns[k][live])
        return out.reshape(-1)[:n]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        group, held = [], 0
        for i, text in enumerate(texts):
            if "<|" in text:
                total[i] = len(self.special.findall(text))
                text = self.special.sub("\n", text)
            group.append((i, text))
            held += len(text)
            if held >= SLICE:
                self._count(group, total)
                group, held = [], 0
        self._count(group, total)
        return total

    def _count(self, group: list[tuple[int, str]], total: np.ndarray) -> None:
        if not group:
            return
        texts = [t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for _, t in group]
        texts = [t.replace("İ", "i̇") if "İ" in t else t for t in texts]
        lower, kind, width = _tables()
        chars = lower[np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)]
        kinds = kind[chars]
        first = np.ones(len(chars) + 1, bool)
        first[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        for at in np.flatnonzero((chars == 0x27) & first[:-1]):
            after = chars[at + 1 : at + 3]
            for c in CONTRACTIONS:
                if len(after) >= len(c) and all(after[k] == ord(x) for k, x in enumerate(c)):
                    first[at + 1] = False
                    first[at + 1 + len(c)] = True
                    break
        widths = width[chars]
        data = np.frombuffer(chars.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        stops = np.cumsum(widths)
        symbols = data.astype(np.int64)
        symbols[stops[first[1:]] - 1] += 256
        kept = kinds != SPACE
        keep = np.repeat(kept, widths)
        gains = self.gains(symbols[keep])
        # symbols kept up to the end of each text
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths + 1) - 1
        running = np.concatenate([[0], np.cumsum(np.where(kept, widths, 0))])
        sums = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
        bounds = sums[running[np.minimum(ends, len(chars))]]
        total[[i for i, _ in group]] += np.diff(np.concatenate([[0], bounds]))


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point: its lower case, its class, its bytes in UTF-8."""
    if not _TABLES:
        n = sys.maxunicode + 1
        lower, kind = np.arange(n, dtype=np.uint32), np.full(n, OTHER, np.uint8)
        for cp in range(n):
            ch = chr(cp)
            major = unicodedata.category(ch)[0]
            if major == "L":
                kind[cp] = LETTER
            elif major == "N":
                kind[cp] = NUMBER
            low = ch.lower()
            if low != ch and len(low) == 1:
                lower[cp] = ord(low)
        kind[list(WHITE)] = SPACE
        width = np.ones(n, np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width[limit:] += 1
        _TABLES.extend((lower, kind, width))
    return _TABLES


_COMPILED: dict[int, Transducer] = {}


def count_tokens(df: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = MAX_TOKENS) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``.  The vocabulary file's text is sent to the executors."""
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf(LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        key = hash(vocabulary_path)
        if key not in _COMPILED:
            _COMPILED[key] = Transducer(shared.value)
        return pd.Series(_COMPILED[key].count(texts.fillna("").tolist()))

    text: Column = F.col(text_col)
    out = df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), "n_tokens": tokens(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
