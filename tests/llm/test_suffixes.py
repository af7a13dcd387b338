"""Removal of repeated byte strings against a plain version."""

import hashlib

import numpy as np
import pytest

from marlstone.llm import suffixes

W = suffixes.WINDOW


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of (doc_id, text) whose ids differ, nulls last."""
    data = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    seen, out = set(), []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        new = set()
        for k in range(len(b) - W + 1):
            s = b[k : k + W]
            if s in seen or s in new:
                gone[k : k + W] = True
            new.add(s)
        seen |= new
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, did int, spans string").repartition(parts)
    return sorted((tuple(r) for r in suffixes.digest(suffixes.without_repeats(docs)).collect()), key=repr)


def corpus():
    rng = np.random.default_rng(12)
    pool = ["".join(rng.choice(list("abcdeéß "), rng.integers(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(pool, n))
    passage, base = prose(60), prose(150).split(" ")
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 99), (4, "a" * 100), (5, "a" * 260), (6, "ab" * 200), (7, "x" + "ab" * 90), (None, passage)]
    for i in range(10, 70):
        kind = i % 6
        if kind == 0:
            text = prose(80)
        elif kind == 1:  # near copies
            text = " ".join(w if rng.random() > 0.03 else "edit" for w in base)
        elif kind == 2:
            text = f"{prose(20)} {passage} {prose(20)}"
        elif kind == 3:  # a part of the passage
            at = int(rng.integers(0, 200))
            text = f"{prose(5)}{passage[at : at + int(rng.integers(95, 140))]}{prose(5)}"
        elif kind == 4:
            text = " ".join(base)
        else:  # within one document
            part = prose(30)
            text = f"{part} {prose(3)} {part}{part}"
        rows.append((i * 3 % 97 + 100 if kind else i * 1000, text))
    return [r for k, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:k]]]


def test_every_kind_of_repeat(spark):
    rows = corpus()
    want = plain(rows)
    assert sum(r[2] for r in want) > 5000
    assert found(spark, rows) == want


def test_hot_anchors_slices_and_little_memory(spark, monkeypatch):
    """Thresholds so small that every path is taken."""
    rows = corpus()[::2]
    want = plain(rows)
    monkeypatch.setattr(suffixes, "HOT", 2)
    assert found(spark, rows) == want
    for name, value in (("SLICE", 150), ("REMEMBERED", 200), ("SORTED", 300), ("HOT", 5)):
        monkeypatch.setattr(suffixes, name, value)
    got = suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == sum(r[2] > 0 for r in want)
    # the same functions, in this process, where the small values hold
    runs = {}
    for did, text in ((i if i is not None else 2**63 - 1, (t or "").encode()) for i, t in rows):
        for data, ends, _, offsets in suffixes._slices([text]):
            for key, anchor, first, last in zip(*suffixes.anchored_runs(data, ends), strict=True):
                for k in range(first, last + 1):
                    window = text[offsets[0] + k : offsets[0] + k + W]
                    runs.setdefault(window, set()).add((int(key), int(anchor - k)))
        assert len(text) < W or {text[k : k + W] for k in range(len(text) - W + 1)} <= set(runs), did
    assert all(len(places) == 1 for places in runs.values())  # equal windows have equal anchors at equal places


def test_pieces_cover_each_window_once():
    for first, last, anchor in ((10, 60, 70), (10, 10, 10), (5, 76, 81), (33, 41, 50)):
        some = list(suffixes._pieces(anchor, first, last, True))
        assert sorted(k for lo, hi, _, _ in some for k in range(lo, hi + 1)) == list(range(first, last + 1))
        for lo, hi, start, size in some:
            assert hi <= start and start + size <= lo + W and hi - lo < suffixes.STRETCH


def test_names_of_any_number():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 3, 500) + offset for offset in (0, 1 << 21, 1 << 22)]
    got = suffixes._ranked(*parts)
    order = sorted(set(zip(*parts, strict=True)))
    assert got.tolist() == [order.index(x) for x in zip(*parts, strict=True)]


def test_sort_finds_what_equals():
    rng = np.random.default_rng(4)
    middle = bytes(rng.integers(97, 99, 40, dtype=np.uint8))
    contents, places = [], []
    for _ in range(60):
        left, right = (bytes(rng.integers(97, 99, rng.integers(30, 50), dtype=np.uint8)[-n:]) for n in (45, 45))
        left, right = rng.choice([left, b"b" * 33, b"ab" * 20]), rng.choice([right, b"a" * 40])
        contents.append(bytes(left) + middle + bytes(right))
        places.append(len(left))
    some = [(c, p) for c, p in zip(contents, places, strict=True) if len(c) >= W]
    got = suffixes.repeated_windows([c for c, _ in some], [p for _, p in some])
    seen = set()
    for (c, p), again in zip(some, got, strict=True):
        own = [(k - p, c[k : k + W]) for k in range(len(c) - W + 1)]
        assert again.tolist() == [w in seen for w in own]
        seen |= set(own)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x" * 30), (1, "x" * 30)]])
def test_nothing_to_find(spark, rows):
    assert all(r[2:4] == (0, 0) for r in found(spark, rows)) and len(found(spark, rows)) == len(rows)


def test_repeated_rows_are_one_document(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 300))
    got = found(spark, [(1, text), (1, text), (2, text)])
    assert [r[2] for r in got] == [0, 0, 300]
