import random
import re
from collections import defaultdict

import duckdb
import pytest

from marlstone.llm import graph, ngramjoin

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc index -> (size, smallest id of its component)."""
    sets = [shingles(t) for _, t in rows]
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in lists[x]:
                if j < i:
                    shared[j] += 1
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(s), least.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, sid string")
    got = [tuple(r) for r in ngramjoin.similar_groups(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_edge_rows(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two"), (None, ""),
        (7, "a b c d e"), (8, "A b C d e"), (9, "a b c d e f"), (9, "a b c d e f"), (10, " ".join(base)), (11, " ".join(base[:-1] + ["z"])),
        (12, " ".join(base[1:])), (13, "É é"), (14, "é é"), (15, " ".join(base * 3000)), (16, " ".join(base * 3000 + ["t"])),
    ]
    check(spark, rows)


def test_random_edits_small_and_large(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for size in (6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 24, 28, 33, 40, 60, 120):
        for _ in range(6):
            text = [f"v{rng.randint(0, 400)}" for _ in range(size)]
            for _ in range(5):
                copy = list(text)
                for _ in range(rng.randint(0, max(1, size // 20))):
                    k = rng.randrange(len(copy))
                    copy[k : k + rng.randint(0, 1)] = [f"v{rng.randint(0, 400)}"] * rng.randint(0, 1)
                rows.append((n, " ".join(copy)))
                n += 1
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("salted, light", [(False, None), (False, 1), (True, 64)])
def test_table(spark, monkeypatch, salted, light):
    if salted:  # every repeated key is dealt over salts
        monkeypatch.setattr(ngramjoin, "LIST_ROWS", 2)
    if light:  # any boundary and any order give the same result
        monkeypatch.setattr(ngramjoin, "boundary", lambda sizes: light)
        rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    else:
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_sql_agrees_with_plain_search():
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    rows = con.sql("select doc_id, text from documents").fetchall()
    assert sorted(con.sql(ngramjoin.SQL).fetchall()) == sorted(brute(rows))


def test_empty(spark):
    assert ngramjoin.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(500, 500 + k) for k in range(1, 200)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}
