"""Ranked lexical search against a plain version of its contract."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import lexical

DOCS, ITEMS = "doc_id long, text string, score double, term string", "item_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(docs, items, k, repeats=False):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    total, df = sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * len(held) // total
            s = sum((times if repeats else 1) * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=lexical.K, repeats=False):
    d = spark.createDataFrame([(i, t, 1.5, "x") for i, t in docs], DOCS).repartition(3)
    return sorted((tuple(r) for r in lexical.rank(d, spark.createDataFrame(items, ITEMS), k, repeats).collect()), key=repr)


CASES = [
    (1, "Alpha beta, BETA gamma"), (2, None), (3, ""), (4, "... !!"), (5, "beta beta beta"), (5, "beta beta beta"), (None, "alpha delta"), (6, "Grün grün ÄPFEL x1"),
    (7, "alpha " * 3000 + "omega"), (8, "alpha beta"), (9, "alpha beta"), (10, "ÄPFEL"),
]
ASKED = [(1, "alpha BETA beta"), (2, None), (3, "nothing here"), (4, "äpfel Äpfel grün"), (1, "omega"), (None, "gamma")]


def test_small_cases(spark):
    for k in (2, 50):
        for repeats in (False, True):
            assert ranked(spark, CASES, ASKED, k, repeats) == plain(CASES, ASKED, k, repeats)


def test_many_documents_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(pool, rng.integers(1, 12)))) for i in range(400)]
    items = [(i, " ".join(rng.choice(pool, 6))) for i in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)  # several blocks of items
    monkeypatch.setattr(lexical, "FAN_IN", 2)
    assert ranked(spark, docs, items, 7) == plain(docs, items, 7)


def test_product_block_is_the_matrix_product():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 3, (6, 10)), rng.integers(0, 4, (10, 15))
    terms, columns = np.nonzero(right)
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in left]
    got = dict(lexical.product_block(rows, terms, columns, right[terms, columns], 10, 15))
    assert (np.stack([got[i] for i in range(6)]) == left @ right).all()


@pytest.mark.parametrize("docs,items", [([], ASKED), (CASES, []), ([(1, None), (2, "?")], ASKED)])
def test_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == []
