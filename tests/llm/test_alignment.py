"""Cross-tokenizer alignment against the libraries and a plain sweep."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import alignment
from marlstone.llm.tokens import _byte_letters

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    letters = _byte_letters()
    spelt = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|")}
    return a, spelt, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(libraries, text):
    a, spelt, b = libraries
    if not text:
        return [], []
    of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    left = [(i, spelt[i]) for i in of_a]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in of_b]
    same = b"".join(s for _, s in left) == b"".join(s for _, s in right) == (" " + text).encode()
    return (left, right) if same else ([], [])


def plain(libraries, texts):
    """The columns of each text, by dictionaries of ends."""
    seen, count = [], Counter()
    for text in texts:
        left, right = tokens(libraries, text)
        ends = [dict(zip(np.cumsum([len(s) for _, s in side]).tolist(), range(len(side)), strict=True)) if side else {} for side in (left, right)]
        at, groups, links = (0, 0), [], []
        for end in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(str(x) for x, _ in left[at[0] : i]) + "|" + ",".join(str(x) for x, _ in right[at[1] : j]))
            links.append((left[i - 1][0], right[j - 1][0]))
            at = i, j
        count.update(links)
        seen.append((len(left), len(right), groups, links))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (a, b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, x in seen
    ]


PARTS = ["the", "Grüße", "don't", "we'LL", "x1y22", "1234567", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "日本語", "🙂", "é", " ", "\n", "\n\n", "  ", "\t", " ", "\r\n", ".", "...", "(a)", "\x00", "\x1c", "　", "straße", "A" * 70]


def test_hard_texts_equal_the_libraries(spark, libraries):
    rng = np.random.default_rng(8)
    texts = [None, "", " ", "  ", "\n", "a", " a ", "▁", "x ▁y", "a▁b", "same text here", "same text here", "ab " * 3000, "a" * 5000, "word " * 200 + "▁"]
    texts += ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.integers(1, 30))) for _ in range(400)]
    rows = [(None if i == 5 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, key string, n_a long").repartition(3), *PATHS)
    assert got.columns[0] == "doc_id"
    want = sorted(((r[0], *p) for r, p in zip(rows, plain(libraries, texts), strict=True)), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", *COLUMNS).collect()), key=repr) == want


def test_runs_and_rows_of_any_length_agree(spark, libraries, monkeypatch):
    texts = [" ".join(PARTS) * 3, "bcd " * 50, "aaaa" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *p) for i, p in enumerate(plain(libraries, texts)))
    monkeypatch.setattr(alignment, "RUN_BYTES", 16)
    monkeypatch.setattr(alignment, "ROW_LINKS", 5)
    monkeypatch.setattr(alignment, "MEMORY", 3)
    assert sorted(tuple(r) for r in alignment.align(docs, *PATHS).select("doc_id", *COLUMNS).collect()) == want


def test_machine_takes_runs_cut_anywhere(libraries):
    """Runs of either side that end inside a group."""
    files = open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read()
    tables = alignment.Tables(alignment.Vocabularies(*files))
    left, right = tokens(libraries, "Unusual tokenization boundaries, naïvely misaligned everywhere")
    runs = []
    for side, (toks, step) in enumerate(((left, 2), (right, 3))):
        ends = np.cumsum([0] + [len(s) for _, s in toks])
        runs += [(int(ends[k]), side, np.array([i for i, _ in toks[k : k + step]])) for k in range(0, len(toks), step)]
    whole, parts = alignment.Machine(tables, True), alignment.Machine(tables, True)
    for side, toks in enumerate((left, right)):
        whole.read(side, 0, np.array([i for i, _ in toks]))
    for start, side, ids in sorted(runs, key=lambda r: r[:2]):
        parts.read(side, start, ids)
    assert whole.row(1, 1, True) == parts.row(1, 1, True)
    assert whole.n_groups > 5


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_every_link_is_listed_and_the_list_is_bounded(libraries):
    files = open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read()
    v = alignment.Vocabularies(*files)
    pairs = alignment.linkable(v)
    assert v.cuts and len(pairs) < sum(map(len, v.a_bytes)) + sum(map(len, v.b_bytes))
    for pair in pairs[:: len(pairs) // 500].tolist():
        a, b = v.a_bytes[pair >> 16], v.b_bytes[pair & 0xFFFF]
        assert a.endswith(b) or b.endswith(a)
