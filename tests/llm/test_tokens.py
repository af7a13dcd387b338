import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def machine():
    return tokens.Transducer(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(machine, library, texts):
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = machine.count(texts).tolist()
    assert [(t[:200], g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_hand_cases(machine, library):
    same(machine, library, [
        "", " ", "a", "\n\n", "Hello world's don't they'RE ''s a's's 'sabc 'd'll'", "x" * 5000, "<|endoftext|>a<|startoftext|><|endoftext|>",
        "İstanbul ΟΔΟΣ ŉ é ́a", "漢字かな交じり文 123 ⅷ ½", "😀😀 !!!???...", "a b　c\u0085d​e", "<|endoftext", "ab" * 3000 + "'s",
        "antidisestablishmentarianism" * 40, "\x00\x1c\x1f ﻿", "'", "it's 'tis '", "<|ENDOFTEXT|>",
    ])


def test_random(machine, library):
    rng = random.Random(3)
    pools = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr ", "aeiou'st ", "éèüößçñ ae", "0123456789 .,'!?", "漢字кириллица😀 "]
    same(machine, library, ["".join(rng.choice(rng.choice(pools) if rng.random() < 0.2 else pool) for _ in range(rng.randint(0, 120))) for pool in pools for _ in range(300)])


def test_chunk_borders(machine, library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 5)
    monkeypatch.setattr(tokens, "SLICE", 50)
    test_hand_cases(machine, library)


def test_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars").withColumnRenamed("n_chars", "n_bytes")
    extra = spark.createDataFrame([(-1, None, 0), (-1, None, 0), (None, "a b", 0)], docs.schema)
    rows = tokens.count_tokens(docs.union(extra), PATH).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


def test_words_longer_than_chunks(machine, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(30_000)), "ab" * 20_000, "a" * 20_001, "abc" * 9_000 + " end", "ha" * 700 + "x" + "ha" * 5_000]
    same(machine, library, texts)


def test_one_word_of_a_million_letters(machine):
    rng = random.Random(1)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    spread = "".join(word[i : i + 7] + " " for i in range(0, len(word), 7))
    machine.count([word[:2000], spread[:100_000]])
    began = time.perf_counter()
    machine.count([spread])
    plain = time.perf_counter() - began
    began = time.perf_counter()
    machine.count([word])
    assert time.perf_counter() - began < 15 * plain + 5
