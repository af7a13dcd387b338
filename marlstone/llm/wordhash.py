"""Word hashes of many texts at once, from their UTF-8 bytes.

A word's hash is a polynomial in random values of its bytes, modulo 2**64,
taken from running sums, and then mixed.  Texts are read in slices of bounded
size; a text longer than a slice is cut at a separator, so no word is split and
memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 18
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

#: The white space of the word contract; A-Z are folded by value.
SPACES = (0x20, *range(0x09, 0x0E))
BY_SPACE = np.ones(256, bool)
BY_SPACE[list(SPACES)] = False
#: Words as letters and digits: any byte beyond ASCII counts as a letter.
BY_LETTER = np.zeros(256, bool)
for _range in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    BY_LETTER[list(_range)] = True
FOLDED = _VALUES.copy()
FOLDED[0x41:0x5B] = _VALUES[0x61:0x7B]

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE)]))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _words(data: np.ndarray, inside: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one slice.

    With ``prefix``, two hashes: the word's, and that of its first bytes.
    """
    up, down = _tables(len(data))
    within = np.zeros(len(data) + 2, np.int8)
    within[1:-1] = inside[data]
    edges = np.diff(within)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(FOLDED[data] * up[: len(data)], out=sums[1:])

        def upto(ends: np.ndarray) -> np.ndarray:
            hashes = (sums[ends] - sums[starts]) * down[starts]
            return mix(hashes ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        whole = upto(ends)
        if prefix:
            return np.stack([whole, mix(upto(np.minimum(ends, starts + prefix)) + np.uint64(1))], axis=1), starts
    return whole, starts


def _pieces(data: bytes, inside: np.ndarray) -> Iterator[bytes]:
    """Cuts a long text at separators; only a word longer than a slice makes a longer piece."""
    at = 0
    while len(data) - at > 2 * SLICE:
        end = at + SLICE
        window = inside[np.frombuffer(data, np.uint8, min(len(data) - end, SLICE), end)]
        while window.all() and end + len(window) < len(data):
            end += len(window)
            window = inside[np.frombuffer(data, np.uint8, min(len(data) - end, SLICE), end)]
        end = len(data) if window.all() else end + int(np.argmin(window))
        yield data[at:end]
        at = end
    yield data[at:]


def slices(texts: list[str], inside: np.ndarray, prefix: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text exclusive, hashes, words per text) over groups of texts.

    A text that alone exceeds a slice comes by itself, its words joined.
    """
    group: list[bytes] = []
    first, held = 0, 0

    def done(end: int):
        data = np.frombuffer(b" ".join(group), np.uint8)
        hashes, starts = _words(data, inside, prefix)
        ends = np.cumsum([len(b) + 1 for b in group])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        return first, end, hashes, counts

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > 2 * SLICE:
            if group:
                yield done(i)
            hashes = np.concatenate([_words(np.frombuffer(p, np.uint8), inside, prefix)[0] for p in _pieces(data, inside)])
            yield i, i + 1, hashes, np.array([len(hashes)])
            group, first, held = [], i + 1, 0
            continue
        group.append(data)
        held += len(data)
        if held > SLICE:
            yield done(i + 1)
            group, first, held = [], i + 1, 0
    if group:
        yield done(len(texts))
