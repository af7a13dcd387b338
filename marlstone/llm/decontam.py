"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised alike: letters and digits in lower case, every run of other
characters one blank.  A document is contaminated by an item if some substring
of it is within ``MAX_EDITS`` percent of the item's length in edit distance.

An occurrence with at most k edits of an item of m characters shares at least
``m - q + 1 - k q`` of its q-grams, and all of them lie within k diagonals.
Shared q-grams (document position, item position) are counted in overlapping
bands of diagonals, each twice as wide as the budget plus one, so an occurrence
is whole within one of them; bands with fewer q-grams than the lemma asks for
are dropped, neighbouring ones that remain are merged, and only these regions
are verified by an alignment confined to their diagonals, which stops once no
cell is within the budget.  Items of 13 to 15 characters, for which the lemma
asks for nothing with ``Q``, use ``SHORT_Q``.  Items of fewer than ``Q``
characters have no edits and are searched as whole words.

The items are cut into blocks of at most ``BLOCK_CHARS`` characters.  One block
is broadcast at a time: with several, each block's result is written before the
next is sent, so what is broadcast has a fixed bound however many items there
are.  Whole documents are read, in one pass for each block.  Time and memory
grow with a text's length, also where text and items repeat themselves.

Null or blank texts are clean; null or blank items match nothing.  Items with
the same text each count.  Repeated documents give repeated rows.  Of the
documents' other columns none is used; ``remove_contaminated`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage

Q, SHORT_Q = 8, 6
MAX_EDITS = 8
#: Characters of items broadcast at once.
BLOCK_CHARS = 4_000_000
#: Pairs of equal q-grams of a document and the items expanded at once.
PAIRS = 1 << 20
_BLANK = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """By code point below 2**16: its lower case, or a blank."""
    table = np.full(1 << 16, _BLANK, np.uint32)
    for cp in range(1 << 16):
        low = chr(cp).lower()
        if low.isalnum():
            table[cp] = ord(low[0])
    return table


_FOLD: list[np.ndarray] = []


def normal(text: str) -> np.ndarray:
    """Code points of the normalised text, without blanks at its ends."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(cp < 1 << 16, _FOLD[0][np.minimum(cp, 65535)], cp)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _BLANK) | (out[:-1] != _BLANK)
    out = out[keep]
    first = 1 if len(out) and out[0] == _BLANK else 0
    last = len(out) - 1 if len(out) > first and out[-1] == _BLANK else len(out)
    return out[first:last].astype(np.uint32)


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    n = max(0, len(chars) - q + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            out = (out + chars[k : k + n]) * _MULT
    return out ^ (out >> np.uint64(29))


def budget(m: int) -> int:
    return m * MAX_EDITS // 100


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int = 1 << 20) -> int:
    """Fewest edits between the item and any substring of the text, on diagonals low to high, if at most ``most``.

    A diagonal is the text position less the item position.  One row per item
    character; insertions run along the row by a running minimum.
    """
    width = high - low + 1
    far = 1 << 20
    steps = np.arange(width)
    at = low + steps  # text position before which the cell stands, for item position 0
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    for i, ch in enumerate(item):
        at = low + i + steps
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(width, np.int64)
        same[ok] = text[at[ok]] != ch
        new = np.where(ok, row + same, far)  # the item's character against the text's
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # the item's character missing
        new = np.minimum.accumulate(new - steps) + steps  # extra characters of the text
        end = at + 1
        row = np.where((end >= 0) & (end <= len(text)), new, far)
        if row.min() > most:
            break
    return int(row.min())


class Index:
    """The q-grams of some items, each as many as the lemma needs."""

    def __init__(self, q: int, chars: dict[int, np.ndarray]):
        self.q = q
        need = np.zeros(max(chars, default=-1) + 1, np.int64)
        for i, c in chars.items():
            need[i] = len(c) - q + 1 - budget(len(c)) * q
        grams = [qgrams(c, q) for c in chars.values()]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(list(chars), np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        # Half of an item's surplus of q-grams, the most common ones, need not be
        # indexed: each left out lowers what the lemma asks for by one.
        _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((-often[which], owner))
        rank = np.arange(len(flat)) - np.searchsorted(owner[order], owner[order], "left")
        indexed = np.zeros(len(flat), bool)
        indexed[order] = rank >= need[owner[order]] // 2
        self.need = need - need // 2
        flat, place, owner = flat[indexed], place[indexed], owner[indexed]
        order = np.argsort(flat, kind="stable")
        self.gram, self.owner, self.place = flat[order], owner[order], place[order]
        self.step = np.zeros(len(need), np.int64)
        for i, c in chars.items():
            self.step[i] = budget(len(c)) + 1
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.gram >> np.uint64(44)] = True

    def regions(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low diagonal, high diagonal) of bands with as many shared q-grams as the lemma asks for, merged."""
        grams = qgrams(chars, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(44)])
        if not len(at):
            return []
        first, last = np.searchsorted(self.gram, grams[at], "left"), np.searchsorted(self.gram, grams[at], "right")
        hits = last - first
        at, first, hits = at[hits > 0], first[hits > 0], hits[hits > 0]
        if not len(at):
            return []
        total = np.cumsum(hits)
        cuts = np.unique(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)))
        bands, counts = [], []
        for some in np.split(np.arange(len(at)), cuts):
            if len(some):
                key = self._bands(at[some], first[some], hits[some])
                key, count = np.unique(key, return_counts=True)
                bands.append(key)
                counts.append(count)
        key, count = bands[0], counts[0]
        if len(bands) > 1:
            key, where = np.unique(np.concatenate(bands), return_inverse=True)
            count = np.bincount(where, np.concatenate(counts))
        key = key[count >= self.need[key >> 41]]
        item, shift, band = key >> 41, (key >> 40) & 1, (key & ((1 << 40) - 1)) - (1 << 39)
        low = (2 * band - shift) * self.step[item]
        high = low + 2 * self.step[item] - 1
        found: list[tuple[int, int, int]] = []
        for k in np.lexsort((low, item)):
            if found and found[-1][0] == item[k] and low[k] <= found[-1][2] + 1:
                found[-1] = (found[-1][0], found[-1][1], max(found[-1][2], int(high[k])))
            else:
                found.append((int(item[k]), int(low[k]), int(high[k])))
        return found

    def _bands(self, at: np.ndarray, first: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """For every pair of equal q-grams its two bands, each 2 * step wide and step from the next of the other shift."""
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
        item, diagonal = self.owner[entry], np.repeat(at, hits) - self.place[entry]
        step = self.step[item]
        keys = [(item << 41) + (shift << 40) + np.floor_divide(diagonal + shift * step, 2 * step) + (1 << 39) for shift in (0, 1)]
        return np.concatenate(keys)


class Items:
    """A block of items, indexed by the q-gram length that suits each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.chars = [], []
        for item_id, text in items:
            chars = normal(text)
            if len(chars):
                self.ids.append(item_id)
                self.chars.append(chars)
        self.budgets = [budget(len(c)) for c in self.chars]
        by: dict[int, dict[int, np.ndarray]] = {0: {}, Q: {}, SHORT_Q: {}}
        for i, c in enumerate(self.chars):
            q = next((q for q in (Q, SHORT_Q) if len(c) - q + 1 - self.budgets[i] * q > 0), 0)
            by[q if q == Q or self.budgets[i] else 0][i] = c
        self.words = [(i, f" {_text(c)} ") for i, c in by[0].items()]
        self.indexes = [Index(q, by[q]) for q in (Q, SHORT_Q) if by[q]]

    def hits(self, chars: np.ndarray) -> list[tuple[int, int]]:
        """(item id, edits) of every item within its budget."""
        best: dict[int, int] = {}
        for index in self.indexes:
            for i, low, high in index.regions(chars):
                k, m = self.budgets[i], len(self.chars[i])
                if best.get(i, k + 1) == 0:
                    continue
                low, high = low - k, high + k
                from_ = max(0, low)
                edits = banded_distance(self.chars[i], chars[from_ : max(0, high + m)], low - from_, high - from_, k)
                if edits <= k:
                    best[i] = min(edits, best.get(i, edits))
        if self.words:
            text = f" {_text(chars)} "
            best |= {i: 0 for i, word in self.words if word in text}
        return [(self.ids[i], edits) for i, edits in sorted(best.items())]


def _text(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def _hits(shared):
    """Text to the items found in it, with their edits."""

    @F.pandas_udf("array<struct<item_id:bigint,edits:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(shared.value)
        for texts in parts:
            yield pd.Series([[{"item_id": i, "edits": e} for i, e in items.hits(normal(t))] for t in texts.fillna("")], dtype=object)

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits): one row per document row and item found in it."""
    found = None
    for block, alone in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        part = docs.select("doc_id", _hits(shared)(F.col("text")).alias("_hits")).select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.item_id", "h.edits")
        if not alone:
            part = stage(part, "overlaps")
            shared.destroy()
        found = part if found is None else found.union(part)
    return found


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items in blocks of bounded size, read from the table as a stream; an empty one if there are none.  And whether it is the only one."""
    block, held, any_ = [], 0, False
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if block and held + len(r["text"]) > BLOCK_CHARS:
            yield block, False
            block, held, any_ = [], 0, True
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    yield block, not any_


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found; columns unchanged.

    Flags every row where it is read, so no join on ids is needed.
    """
    for block, alone in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.where(F.size(_hits(shared)(F.col("text"))) == 0)
        if not alone:
            docs = stage(docs, "clean-documents")
            shared.destroy()
    return docs
